"""What commands, paths, branches and tool summaries of agent runs say.

A summary is the JSON of a call's arguments or answer as text, perhaps cut off or no JSON at all.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import json_field

#: Words of builds and tests, of failed output, of reverts and of commits.
BUILD_WORDS = ("cargo build", "cargo test", "cargo check", "cargo run", "go build", "go test", "go run", "pytest", "python -m pytest", "npm run build", "npm run test", "npm test", "make test", "make build", "mvn test", "mvn build", "gradle test", "gradle build", "tsc ", "python setup.py")
FAIL_WORDS = ("error[e", "error[", " failed", "fail\n", "fail\t", "fail ", "^fail$", "panic:", "cannot ", "undefined: ", "exit status 1", "command not found", "no such file", "syntax error", "compilation failed", "does not compile", "build constraints exclude", " error:", "error: aborting", "test result: fail", "tests failed")
REVERT_WORDS = ("git checkout ", "git restore ", "git reset ", "git revert ", "git stash")
COMMIT_WORDS = ("git commit", "git push")
STDERR_WORDS = ("error:", "fatal:", "failed", "panicked")
CARGO_WORDS = ("cargo build", "cargo test", "cargo run", "cargo check", "cargo bench")
#: Classes of commands, the first that matches.
CLASSES = [
    ("build", r"(?i)\b(make|ninja|cmake|cargo\s+(build|check)|go\s+build|tsc|webpack|vite\s+build|gradle|mvn\s+package|build\.sh)\b"),
    ("run-verify", r"(?i)\b(cargo\s+test|pytest|go\s+test|jest|vitest|npm\s+test|ctest)\b"),
    ("explore", r"(?i)\b(grep|rg|find|ls|cat|head|tail|stat|sed|awk)\b"),
    ("wait", r"(?i)\bsleep\s+\d"),
]
TOOL_CLASSES = {"explore": ("Read", "Grep", "Glob", "LS", "NotebookRead"), "edit": ("Edit", "Write", "MultiEdit", "NotebookEdit"), "dispatch": ("Task",)}
#: A wait, and the look that makes it a poll.
POLL, PEEK = r"(?i)\bsleep\s+\d", r"(?i)\b(cat|tail|head|status|ls|stat|grep)\b"
#: Commands that settle a run.
SETTLING = r"\bgit\b.*\bcommit\b|\bgit\b.*\bpush\b|gh pr create|\bbd\s+close\b|\bbd\s+update\b"
#: Claims of a clean baseline.
CLAIM = r"(?i)tests?\s+(?:are\s+)?(?:all\s+)?(?:green|passing|clean)|suite\s+is\s+(?:green|passing|clean)|baseline\s+is\s+(?:green|clean|passing)|pre.?existing\s+(?:failure|breakage|test)|as\s+pre.?existing|treat\s+.{0,40}?\bas\s+pre.?existing|(?:failure|test)\s+is\s+pre.?existing|already\s+(?:failing|broken)\s+(?:before|on\s+main)|known(?:[ -]good)?\s+baseline"
#: Files that steer an agent.
HARNESS = [
    ("CLAUDE.md", r"(?:^|[\s/])CLAUDE\.md\b"), ("AGENTS.md", r"(?:^|[\s/])AGENTS\.md\b"), (".claude/hooks", r"\.claude/hooks/"), (".claude/skills", r"\.claude/skills/"),
    ("settings.json", r"\.claude/settings(?:\.local)?\.json\b"), ("hermes/routing.toml", r"\.config/hermes/routing\.toml\b"),
]
#: Paths that are no code, by folder and by ending.
NO_CODE_FOLDERS, NO_CODE_ENDINGS = ("/.planning/", "/.beads/", "/knowledge/", "/docs/"), ("md", "txt", "rst", "log", "csv", "lock")
#: Beginnings of branches that name no task.
STRUCTURAL = ("main", "master", "HEAD", "worktree-", "feat/", "fix/", "chore/", "task/", "ci-", "salvage/", "exec/")
#: Fields of a summary that say what a call is about, the first that is filled.
KEY_FIELDS = ("command", "file_path", "pattern", "description", "prompt", "url")
WORKTREE = r"(?:\.claude/worktrees|\.worktrees)/([^/]+)"


def any_of(conditions) -> Column:
    return functools.reduce(operator.or_, conditions)


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, whatever the letter case; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(F.contains(low, F.lit(w)) for w in words)


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    text = F.coalesce(text, F.lit(""))
    return functools.reduce(lambda w, r: w.when(text.rlike(r[1]), r[0]), rules, F).otherwise(F.lit(default))


def is_json(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$").isNotNull(), F.lit(False))


def parsed(raw: Column, key: str) -> Column:
    """A field of a summary that is whole JSON; null where it is cut off."""
    return F.get_json_object(raw, f"$.{key}")


def filled(value: Column) -> Column:
    """Null for what counts as nothing in a summary."""
    return F.when(~value.isin("", "{}", "[]", "null", "false", "0"), value)


def command_class(command: Column) -> Column:
    return first_match(command, CLASSES, "act")


def activity_class(tool: Column, command: Column) -> Column:
    """Of an event: by its command for a shell call, else by the tool."""
    by_tool = functools.reduce(lambda w, c: w.when(tool.isin(*c[1]), c[0]), TOOL_CLASSES.items(), F.when(tool == "Bash", command_class(command)))
    return by_tool.otherwise("act")


def is_build(command: Column) -> Column:
    return has_word(command, BUILD_WORDS)


def verifies(command: Column) -> Column:
    """Builds and tests by their words or by the class of the command."""
    return (F.coalesce(command, F.lit("")) != "") & (is_build(command) | command_class(command).isin("build", "run-verify"))


def output(response: Column) -> Column:
    """stdout and stderr of an answer, each on a line of its own."""
    return F.concat_ws("\n", F.coalesce(parsed(response, "stdout"), F.lit("")), F.coalesce(parsed(response, "stderr"), F.lit("")))


def failed_output(response: Column) -> Column:
    return has_word(output(response), FAIL_WORDS)


def not_found(response: Column) -> Column:
    return has_word(output(response), ("command not found", "no such file or directory"))


def bash_failed(is_error: Column, response: Column) -> Column:
    """By the flag, an exit code other than 0, or errors on stderr of a call that was not interrupted."""
    code = lambda k: F.coalesce(F.try_to_number(parsed(response, k), F.lit("S9999999999")) != 0, F.lit(False))
    errors = has_word(parsed(response, "stderr"), STDERR_WORDS) & F.coalesce(parsed(response, "interrupted") == "false", F.lit(False))
    return F.coalesce(is_error, F.lit(False)) | code("exitCode") | code("exit_code") | errors


def settles(summary: Column, response: Column) -> Column:
    """A commit or push by the structured answer, or a command that settles a run."""
    done = filled(parsed(response, "gitOperation.commit")).isNotNull() | filled(parsed(response, "gitOperation.push")).isNotNull()
    command = F.when(is_json(summary), parsed(summary, "command")).otherwise(summary)
    return done | F.coalesce(command.rlike(SETTLING), F.lit(False))


def human_key(summary: Column) -> Column:
    """What a call is about, in one line; the beginning of a summary that is no JSON."""
    fields = F.coalesce(*[filled(parsed(summary, k)) for k in KEY_FIELDS], F.lit(""))
    return F.when(is_json(summary), F.replace(fields, F.lit("\n"), F.lit(" "))).otherwise(F.substring(summary, 1, 200))


def command_of(summary: Column) -> Column:
    """The command of a summary, or the summary itself where it is plain text; null for none."""
    return F.when(summary == "", None).when(summary.startswith("{") & is_json(summary), parsed(summary, "command")).otherwise(summary)


def edited_path(summary: Column, response: Column) -> Column:
    return F.coalesce(filled(parsed(summary, "file_path")), filled(parsed(response, "filePath")), filled(parsed(summary, "file")), F.lit(""))


def is_code(path: Column) -> Column:
    """Whether editing the path asks for a verification; unknown paths do."""
    p = F.lower(F.coalesce(path, F.lit("")))
    ending = F.regexp_extract(F.regexp_extract(p, r"[^/]*$", 0), r"\.([^.]*)$", 1)
    return ~(has_word(p, NO_CODE_FOLDERS) | ending.isin(*NO_CODE_ENDINGS))


def normal_path(path: Column) -> Column:
    """A path without "." and empty segments and with ".." resolved."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    up = lambda a: (F.size(a) > 0) & (F.element_at(a, -1) != "..")
    none = F.array().cast("array<string>")
    step = lambda a, s: F.when((s == "..") & up(a), F.slice(a, F.lit(1), F.size(a) - 1)).when((s == "..") & path.startswith("/"), a).otherwise(F.concat(a, F.array(s)))
    joined = F.array_join(F.aggregate(parts, none, lambda a, s: F.when(F.size(a) == 0, F.when(s == "..", F.when(path.startswith("/"), none).otherwise(F.array(s))).otherwise(F.array(s))).otherwise(step(a, s))), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def repo_path(path: Column) -> Column:
    """A path below its repository, the same from a worktree and from the repository itself."""
    norm = normal_path(path)
    found = lambda rule: F.nullif(F.regexp_extract(norm, rule, 1), F.lit(""))
    return F.coalesce(found(r"(?:\.claude/worktrees|\.worktrees)/[^/]+/(.+)$"), found(r"/projects/[^/]+/(.+)$"), norm)


def area(path: Column, cwd: Column, project: Column) -> Column:
    """The area of code that an edit touches: its path below the repository, else the last two segments."""
    p = F.coalesce(F.nullif(path, F.lit("")), F.nullif(cwd, F.lit("")))
    rules = [r"^.*/projects/[^/]+/(?:\.claude/worktrees|\.worktrees)/[^/]+/(.*)", r"^.*/projects/[^/]+/(.*)"]
    out = functools.reduce(lambda w, r: w.when(p.rlike(r), F.coalesce(F.nullif(F.regexp_extract(p, r, 1), F.lit("")), project)), rules, F.when(p.isNull(), project))
    return out.otherwise(F.regexp_extract(F.regexp_replace(p, "/+$", ""), r"(?:[^/]*/)?[^/]*$", 0))


def worktree_slug(worktree: Column, cwd: Column) -> Column:
    """The worktree that an event names, else that of its folder; null outside worktrees."""
    return F.coalesce(F.nullif(F.btrim(worktree), F.lit("")), F.nullif(F.regexp_extract(F.coalesce(cwd, F.lit("")), WORKTREE, 1), F.lit("")))


def worktree_root(cwd: Column, slug: Column) -> Column:
    """The absolute folder of a worktree; null where ``cwd`` is not below one."""
    before = F.regexp_extract(F.coalesce(cwd, F.lit("")), r"^(.*?\.claude/worktrees/)", 1)
    return F.when(before != "", F.concat(before, slug))


def run_key(conversation: Column, slug: Column) -> Column:
    return F.when(slug.isNotNull(), F.concat_ws("#", conversation, slug)).otherwise(conversation)


def project_of_folder(cwd: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(cwd, F.lit("")), r"/projects/([^/]+)", 1), F.lit("")), F.lit("(unknown)"))


def in_worktree(cwd: Column) -> Column:
    return has_word(cwd, ("/.claude/worktrees/", "/.worktrees/"))


def crate(command: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(command, r"(?:-p|--package)\s+(\S+)", 1), F.lit("")), F.lit("workspace"))


def task_of_branch(branch: Column) -> Column:
    """The task id that a branch names, behind a loom/, deer-flow/ or deer/ prefix or by itself; else null."""
    name = F.regexp_replace(branch, r"^(loom|deer-flow|deer)/", "")
    looks = name.rlike(r"^[a-z][a-z0-9]*(-[a-z][a-z0-9]*)*-[a-z0-9]{3,6}(\.[^/]*)?$")
    return F.when(~any_of(branch.startswith(p) for p in STRUCTURAL) & looks, name)


def clean_claim(prompt: Column) -> Column:
    """The words by which a prompt claims a clean baseline; empty without."""
    return F.trim(F.regexp_extract(F.coalesce(prompt, F.lit("")), CLAIM, 0))


def harness_label(text: Column) -> Column:
    return first_match(text, HARNESS, None)


def dispatch_fields(summary: Column, response: Column) -> dict[str, Column]:
    """What a dispatch says, also where its summaries are cut off."""
    of = lambda raw, key: F.coalesce(json_field(raw, key), F.lit(""))
    out = {"child": of(response, "agentId")} | {k: of(summary, k) for k in ("prompt", "model", "name", "isolation")}
    return out | {"description": F.coalesce(filled(of(summary, "description")), of(response, "description"))}

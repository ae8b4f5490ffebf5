"""Records and fields of three language families; overlap by prefixes against counting."""

import itertools
import random

from tidewell.functions import records
from tidewell.operators import audits

RUST = 'pub struct Job<T> {}\nstruct Job {\n  pub id: u64,\n  pub(crate) state: HashMap<String, Vec<u8>>,\n  // old: u8,\n  name: &\'a str,\n}\nconst X: &str = "struct No { a: u8 }";'
C = "struct Point {\n  float x; float y[3];\n  unsigned int *next;\n  int flags = {0};\n  struct Inner { int deep; } inner;\n};"
GO = "type Job struct {\n\tID, Name string\n\tTags []string `json:\"tags\"`\n\tsync.Mutex\n\tInner struct {\n\t\tDeep int\n\t}\n}\n"
PY = "class A(Base):\n    x: int\n    y: str = 'a'\n    z = 3\n\n    def f(self):\n        q: int = 1\n\n    class B:\n        w: float\nv: int = 2\n"


def fields(scan, text):
    return {n: f for n, f in scan(text)}


def test_records_by_hand():
    assert fields(records.braced, RUST) == {"Job": {"id", "state", "name"}}
    got = fields(records.braced, C)
    assert got["Point"] >= {"x", "y", "next", "flags"} and got["Inner"] == {"deep"}
    assert fields(records.typed, GO) == {"Job": {"ID", "Name", "Tags", "Inner"}}
    assert fields(records.indented, PY) == {"A": {"x", "y"}, "B": {"w"}}
    assert records.family("a/b.GO") is records.typed and records.family("x.py") is records.indented and records.family("none") is records.braced
    assert fields(records.braced, "struct Open { int a;") == {"Open": {"a"}} and not fields(records.typed, "") and not fields(records.indented, "class ")


def test_record_rows(spark):
    d = spark.createDataFrame([("a.rs", RUST), ("b.go", GO), ("c.py", PY), ("d.c", None), (None, C)], "path string, text string")
    got = {(r.path, r.record, r.field) for r in records.record_fields(d).collect()}
    assert ("a.rs", "Job", "state") in got and ("b.go", "Job", "Name") in got and ("c.py", "B", "w") in got and (None, "Inner", "deep") in got


def test_overlap_equals_counting(spark):
    rng = random.Random(5)
    sets = {f"r{i}": {f"f{min(rng.randrange(25), rng.randrange(25))}" for _ in range(rng.randrange(1, 9))} for i in range(60)}
    rows = [(n, f) for n, s in sets.items() for f in s] + [("r0", None), (None, "f1")]
    d = spark.createDataFrame(rows + rows[:20], "n string, f string")
    for least in (1, 3):
        want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
        assert {(r.a, r.b, r.shared) for r in audits.overlapping(d, "n", "f", least).collect()} == want


def test_overlap_of_many_equal_records_meets_by_class(spark, monkeypatch):
    monkeypatch.setattr(audits, "PIECE", 4)
    sets = {f"r{i}": {"a", "b", "c", f"d{i % 3}"} for i in range(40)} | {"x": {"a", "b", "q"}}
    d = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s], "n string, f string")
    staged, stage = {}, audits.stage
    monkeypatch.setattr(audits, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 3}
    got = audits.overlapping(d, "n", "f", 3).collect()
    assert {(r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)
    assert staged["classes"].count() == 4  # only these are compared

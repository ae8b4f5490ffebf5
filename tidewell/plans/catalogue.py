"""Every registered query with its SQL twin."""

from tidewell.plans import activity, audits, events, measures, outcomes, panels, reducers, runs, texts, transcripts

QUERIES: dict = {**events.QUERIES, **runs.QUERIES, **texts.QUERIES, **panels.QUERIES, **activity.QUERIES, **reducers.QUERIES, **audits.QUERIES, **transcripts.QUERIES, **outcomes.QUERIES, **measures.QUERIES}
ORACLE: dict = {**events.ORACLE, **runs.ORACLE, **texts.ORACLE, **panels.ORACLE, **activity.ORACLE, **reducers.ORACLE, **audits.ORACLE, **transcripts.ORACLE, **outcomes.ORACLE, **measures.ORACLE}

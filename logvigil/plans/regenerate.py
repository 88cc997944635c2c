"""New reports for stored investigations (I10, B8, B1..B6, I11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.operators.investigations import regeneration_input
from logvigil.operators.models import asked_for, parse_answers
from logvigil.operators.reports import prompt_context
from logvigil.operators.summary import threat_summary, top_events_list
from logvigil.session import cut_lineage
from logvigil.sources.store import INV, OWNER, InvestigationStore


def regenerate(store: InvestigationStore, requests: DataFrame, generate: Callable[[DataFrame], DataFrame],
               at: Column) -> DataFrame:
    """Ask for new reports of owned investigations and store the sound ones.

    ``requests`` has user_id and investigation_id.  Only stored rows are read.
    Returns (user_id, investigation_id, report_error): one row per owned request.
    """
    main = store.read().join(requests.select(*OWNER).distinct(), OWNER, "left_semi")
    held = main.select(INV)
    events = store.read("events").join(held, INV, "left_semi")
    nodes = store.read("nodes").join(held, INV, "left_semi")
    context = regeneration_input(main, top_events_list(events), threat_summary(events), nodes)
    # a model answer is costly and may differ when asked twice: keep the first
    raw = cut_lineage(asked_for(generate, prompt_context(context)))
    asked = raw.withColumn("rag_available", F.lit(False)).join(main.select(*OWNER), INV)
    reports = cut_lineage(parse_answers(asked))
    store.regenerate(reports, at)
    return reports.select(*OWNER, "report_error")

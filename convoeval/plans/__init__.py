from importlib import import_module

from convoeval.plans.registry import ORACLES, QUERIES

GROUPS = [
    "scoring_plans", "report_plans", "ledger_plans", "retrieval_plans", "normalise_plans",
    "join_plans", "text_plans", "memory_plans", "answer_plans", "sampling_plans", "profile_plans",
    "incremental_plans", "stream_plans", "source_plans",
]

for _group in GROUPS:
    import_module(f"convoeval.plans.{_group}")

__all__ = ["ORACLES", "QUERIES"]

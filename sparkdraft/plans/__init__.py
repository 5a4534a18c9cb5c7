"""Query bindings; importing this package fills the registry."""

from sparkdraft.plans import (  # noqa: F401
    decode_queries,
    dist_queries,
    document_queries,
    file_queries,
    generation_queries,
    prep_queries,
    profile_queries,
    run_queries,
    summary_queries,
    sweep_queries,
    token_queries,
)
from sparkdraft.plans.registry import ORACLES, QUERIES, table  # noqa: F401

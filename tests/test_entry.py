"""Driver contract: entry(), queries() and their oracles."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 50
    assert set(o) <= set(q)
    from sparkdraft.plans import QUERIES

    assert set(QUERIES) <= set(q)
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["id", "prompt_text", "response_text", "source"]


@pytest.mark.parametrize("name", [
    "first_exchange", "decode_replay", "kd_losses", "sweep_paired_deltas", "loss_ema", "target_generation",
    "summary_flatten", "log_eval_losses", "sampling_configs", "checkpoint_meta_lookup", "cache_coherence",
])
def test_query_matches_oracle_small(spark, name):
    from tools.oracle_check import canon, duck

    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF_SMALL).execute(E.oracle_sql()[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert canon(df.columns, rows) == canon(dcols, drows)

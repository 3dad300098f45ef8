"""classify_side gives each message a result."""

from lotloom.plans.registry import QUERIES


def test_every_turn_is_classified(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").collect()
    assert any(r.turn > 1 for r in rows)
    got = QUERIES["classify_side"](spark, sf_dir).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == sorted((r.conv_id, r.turn) for r in rows)
    assert all(r.side == "sell" for r in got if r.conv_id % 3 == 0) and {r.side for r in got} >= {"buy", "sell"}

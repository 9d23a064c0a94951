"""Layout and path helpers (S3, S5, S6, X2, K8, S12 options)."""

from datetime import datetime

import pytest

from quarry.sinks.writers import dq_table
from quarry.sources.layout import LakeLayout, render_path
from quarry.sources.readers import jdbc_options


def test_layer_paths_and_sandbox_refused_in_prod():
    lay = LakeLayout("abfss://lake@acct.dfs.core.windows.net", "prod")
    assert lay.path("silver", "orders") == "abfss://lake@acct.dfs.core.windows.net/silver/orders"
    assert lay.checkpoint("ingest orders").endswith("/_checkpoints/ingest_orders")
    with pytest.raises(ValueError):
        lay.path("sandbox", "x")
    assert LakeLayout("/lake").asset("gold", "sales", "order", "internal", "all", "daily", 2, "t") == \
        "/lake/gold/sales/order/internal/all/daily/v2/t"


def test_render_path_placeholders_and_globs():
    p = render_path("/raw/{_year}/{_month}/{_day}/h={PARTITION_HOUR}/*.json", datetime(2024, 3, 5, 7))
    assert p == "/raw/2024/3/5/h=7/*.json"
    assert render_path("/raw/{_month:02d}/{a,b}", datetime(2024, 3, 5)) == "/raw/03/{a,b}"


def test_dq_table_names():
    assert dq_table("silver/orders_clean", "rules", "/lake") == \
        ("/lake/silver/_dq/rules/silver_orders_clean", "_dq.silver_orders_clean_rules")


def test_jdbc_options_need_bounds():
    o = jdbc_options("jdbc:postgresql://db/x", "public.t", "id", 1, 1000, 8)
    assert o["numPartitions"] == "8" and o["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")

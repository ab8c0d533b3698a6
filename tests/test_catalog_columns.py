"""Catalog payloads parsed in columns against the dict parsers."""

import json

import pytest

from quillmeter.sources import catalogs as C
from quillmeter.sources.catalog_columns import PAYLOADS, relation

LITELLM = {
    "sample_spec": {"input_cost_per_token": 1, "output_cost_per_token": 1}, "b": {"input_cost_per_token": "1e-6", "output_cost_per_token": 2e-6}, "a": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, "cache_read_input_token_cost": 0, "cache_creation_input_token_cost": "x"},
    "claude-t": {"input_cost_per_token": 3e-6, "output_cost_per_token": 1.5e-5, "cache_creation_input_token_cost_above_1hr": 6e-6, "input_cost_per_token_above_200k_tokens": 6e-6, "cache_read_input_token_cost_above_128k_tokens": 1e-7, "cache_creation_input_token_cost_above_1hr_above_512k_tokens": 1e-5},
    "t": {"input_cost_per_token": 1e-6, "output_cost_per_token": 0, "output_cost_per_token_above_272k_tokens": 5e-6}, "none": {"input_cost_per_token": 1e-6}, "bad": {"input_cost_per_token": True, "output_cost_per_token": 1}, "text": "x", "neg": {"input_cost_per_token": -1e-6, "output_cost_per_token": 1e-6, "cache_creation_input_token_cost_above_1hr": -1},
    "under": {"input_cost_per_token": "1_0", "output_cost_per_token": 1}, "inf": {"input_cost_per_token": "inf", "output_cost_per_token": 1}, "é.x/y z": {"input_cost_per_token": " 1 ", "output_cost_per_token": ".5"},
}
ROUTER = {"data": [{"id": "x/b", "pricing": {"prompt": "0.1", "completion": "0.2"}}, {"id": "x/a", "pricing": {"prompt": "0.000002", "completion": "0", "input_cache_read": "1e-7", "input_cache_write": ""}}, {"id": 5, "pricing": {}}, {"id": "x/b", "pricing": {"prompt": 1, "completion": 2}}, {"id": "y", "pricing": "no"}, "z", {"id": "w"}]}
DEV = {"p": {"models": {"m": {"cost": {"input": 1, "output": 2, "cache_read": 0.1}}, "q/m": {"cost": {"input": 5, "output": 6}}, "free": {"cost": {"input": 0, "output": "0"}}, "no": {}}}, "o": {"models": {"m": {"cost": {"input": 3, "output": 4}}}}, "q": {"models": {"m": {"cost": {"input": 7, "output": 8}}}}, "r": {"models": []}, "s": 1}


def plain(rows):
    return [(r["catalog_ord"], r["source"], r["key"], r["price"].asDict(True)) for r in sorted(rows, key=lambda r: (r["catalog_ord"], r["key_ord"]))]


@pytest.mark.parametrize("payloads", [[("litellm", LITELLM)], [("openrouter", ROUTER)], [("models.dev", DEV)], [("models.dev", DEV), ("litellm", LITELLM), ("openrouter", ROUTER), ("litellm", {})]])
def test_same_prices_as_the_dict_parsers(spark, payloads):
    want = C.relation(spark, [C.parse(kind, data) for kind, data in payloads])
    rows = [(k, kind, kind, None, json.dumps(data)) for k, (kind, data) in enumerate(payloads)]
    got = relation(spark.createDataFrame(rows, PAYLOADS))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert plain(got.collect()) == plain(want.collect())


def test_no_json(spark):
    rows = [(0, "litellm", "l", None, "{"), (1, "openrouter", "o", None, None), (2, "models.dev", "m", None, "[1]"), (3, "litellm", "l", None, "7"), (4, "other", "x", None, json.dumps(LITELLM))]
    assert relation(spark.createDataFrame(rows, PAYLOADS)).count() == 0
    assert relation(spark.createDataFrame([], PAYLOADS)).count() == 0

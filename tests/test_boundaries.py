"""Boundary rules: the index against trying every rule, and the hand-stated samples one by one."""

import re

import pytest

from tests.oracle import ROOT
from tracewell.operators import boundaries as b
from tracewell.plans import catalogue
from tracewell.plans.boundary_queries import SAMPLES

CALL = "id int, lang string, file string, path string, name string, call_kind string, receiver string, receiver_type string, awaited boolean"


def plain(lang, path, name, kind, receiver, receiver_type, awaited, imports):
    """The ordinal of the first rule of the language that holds, all of them tried."""
    for k, r in enumerate(b.RULES.get(lang, ())):
        if (r.awaited is True and not awaited) or ((r.awaited is False or r.blocking) and awaited):
            continue
        if r.unless_name and re.search(r.unless_name, name):
            continue
        if r.path is not None:
            if not re.search(r.path, path):
                continue
        elif (r.methods is not None and (kind == "ident" or name not in r.methods.split())) or (r.name is not None and not re.search(r.name, name)):
            continue
        if (r.receiver and not re.search(r.receiver, receiver)) or (r.receiver_type and not re.search(r.receiver_type, receiver_type or "")):
            continue
        if r.imports and not any(re.search(r.imports, i) for i in imports):
            continue
        return k
    return None


def test_index_finds_what_trying_every_rule_finds(spark):
    """Every path, receiver and library of the samples in every language, awaited or not."""
    calls, imports = [], []
    for i, (_, path, kind, receiver, receiver_type, _, lib, _, _) in enumerate(SAMPLES):
        for lang in b.RULES:
            for awaited in (False, True, None):
                for has in (False, True):
                    file = f"{i}-{has}"
                    calls.append((len(calls), lang, file, path, path.split(".")[-1], kind, receiver, receiver_type, awaited))
                    if has:
                        imports.append((file, lib))
    libs = {}
    for f, lib in imports:
        libs.setdefault(f, set()).add(lib)
    found = b.classify(spark.createDataFrame(calls, CALL), spark.createDataFrame(imports, "file string, imported string"), ["id"])
    got = {r.id: r.ordinal for r in found.collect()}
    want = {}
    for i, lang, file, path, name, kind, receiver, receiver_type, awaited in calls:
        k = plain(lang, path, name, kind, receiver, receiver_type, bool(awaited), libs.get(file, ()))
        if k is not None:
            want[i] = k
    assert got == want and len(set(want.values())) > 20


@pytest.mark.parametrize("sample", SAMPLES, ids=lambda s: f"{s[0]}-{s[1]}-{s[5]}")
def test_samples_are_what_is_stated(sample):
    lang, path, kind, receiver, receiver_type, awaited, lib, with_it, without = sample
    for imports, want in (([lib], with_it), ([], without)):
        k = plain(lang, path, path.split(".")[-1], kind, receiver, receiver_type, awaited, imports)
        r = None if k is None else b.RULES[lang][k]
        assert (r and f"{r.kind}/{r.category}") == want


def test_keys_are_read_from_the_patterns():
    keys = lambda **kw: b.keys_of(b.BoundaryRule("k", "c", **kw))
    assert keys(path=r"^(io\.)?open$|^os\.(stat|walk)$") == {"head:io", "head:open", "head:os"}
    assert keys(path=r"^psycopg2?\.") == {"head:psycopg", "head:psycopg2"}
    assert keys(path=r"(^|\.)block_on$") == {"tail:block_on"}
    assert keys(path=r"^(axios|got)(\.\w+)?$") == {"head:axios", "head:got"}
    assert keys(path=r"^\w+\.get$") == keys(path="get") == keys(path=r"^ab*\.get$") == {b.EVERY}
    assert keys(methods="get put") == {"name:get", "name:put"} and keys(name="^(Invoke|Run)$") == {"name:Invoke", "name:Run"}
    assert keys(name="(?i)fetch") == {b.EVERY}


def test_no_plan_of_rules_times_calls(spark):
    plan = catalogue.QUERIES["boundary_rules"](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_classify(spark):
    none = spark.createDataFrame([], CALL)
    assert b.classify(none, spark.createDataFrame([], "file string, imported string"), ["id"]).count() == 0
    odd = spark.createDataFrame([(1, "python", None, None, None, None, None, None, None), (2, None, "f", "open", "open", "ident", "", None, False)], CALL)
    assert b.classify(odd, spark.createDataFrame([], "file string, imported string"), ["id"]).count() == 0

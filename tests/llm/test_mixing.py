from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.mixing import TooManySlots, exact_parts, mixed, op7_source_mixing, period, phases, schedule, whole_parts


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_deviation_is_less_than_one_block(parts):
    total, served = sum(parts.values()), Counter()
    at = {slot: s for s, slots in period(parts).items() for slot in slots}
    assert sorted(at) == list(range(total))
    for t in range(total):
        served[at[t]] += 1
        assert all(abs(served[s] - Fraction((t + 1) * w, total)) < 1 for s, w in parts.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1))
def test_phases_serve_all_blocks(own):
    blocks = {s: n for s, (_, n) in own.items()}
    slots = []
    for p in phases({s: w for s, (w, _) in own.items()}, blocks):
        for s, base in p["base"].items():
            later = [q["base"].get(s) for q in phases({s: w for s, (w, _) in own.items()}, blocks) if q["first"] > p["first"]]
            end = next((b for b in later if b is not None), blocks[s])
            slots += [p["first"] + (k - base) // p["parts"][s] * p["total"] + p["slots"][s][(k - base) % p["parts"][s]] for k in range(base, end)]
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_whole_parts():
    assert whole_parts({"a": 1, "b": 1, "c": 2}, 100) == {"a": 25, "b": 25, "c": 50}
    assert sum(whole_parts({str(i): i for i in range(7)}, 1000).values()) == 1000
    assert whole_parts({"a": 0.0, "b": 0.0}, 1) == {"a": 1, "b": 1}


def test_whole_table(spark):
    rows = op7_source_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id").collect()
    assert sorted((r.source, r.doc_id) for r in rows) == sorted(map(tuple, docs))
    by_slot = defaultdict(set)
    order = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.slot, r.nth)):
        assert r.release <= r.slot < r.deadline and r.nth < 16
        by_slot[r.slot].add((r.source, r.block))
        order[r.source].append(r.doc_id)
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(b) == 1 for b in by_slot.values())
    assert all(ids == sorted(ids) for ids in order.values())


def test_odd_rows(spark):
    rows = [("a", i, "t") for i in range(100)] + [("b", 1, None), ("b", 1, "x"), (None, 7, "y"), ("", 8, ""), ("c", None, "z")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "source string, doc_id long, text string, slot int")
    got = mixed(docs, weights={"a": 3, "b": 1}, block_docs=2, parts=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.collect())) and got[0].asDict().keys() == {"source", "doc_id", "text", "slot"}
    assert [r.doc_id for r in got if r.source == "a"] == list(range(100))
    assert schedule(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0


def test_exact_parts():
    assert exact_parts({"a": 0.5, "b": "0.3", "c": Fraction(1, 5), "d": 0}) == {"a": 5, "b": 3, "c": 2, "d": 0}
    assert exact_parts({"a": 0.1, "b": 0.2}) == {"a": 1, "b": 2} and exact_parts({}) == {}
    with pytest.raises(ValueError):
        exact_parts({"a": -1})


def slots_of(found, blocks):
    """Each block's (slot, source), phase by phase."""
    out = []
    for i, p in enumerate(found):
        for s, base in p["base"].items():
            end = next((q["base"][s] for q in found[i + 1 :] if s in q["base"]), blocks[s])
            j = range(end - base)
            out += [(p["first"] + k // p["parts"][s] * p["total"] + int(p["slots"][s][k % p["parts"][s]]), s) for k in j]
    return sorted(out)


def test_a_million_slots_follow_the_target_weights():
    """Deviation from the given weights, not from rounded ones; a source of weight 0 comes last."""
    weights = {"half": 0.5} | {f"s{i:02}": Fraction(1, 2 * 19) for i in range(19)} | {"never": 0}
    blocks = {"half": 510_000} | {f"s{i:02}": 30_000 for i in range(19)} | {"never": 10}
    order = [s for _, s in slots_of(phases(exact_parts(weights), blocks), blocks)]
    assert len(order) == sum(blocks.values()) and set(order[-10:]) == {"never"}
    seen = Counter()
    for t, s in enumerate(order[:1_000_000], 1):
        seen[s] += 1
        assert abs(seen[s] - weights[s] * t) < 1
        if t % 997 == 0:
            assert all(abs(seen[x] - weights[x] * t) < 1 for x in weights)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 2000), st.integers(0, 60)), min_size=1))
def test_short_sources_and_long_periods(own):
    """Sources that end within a period; sources of weight 0 after all others."""
    blocks = {s: n for s, (_, n) in own.items()}
    found = slots_of(phases(exact_parts({s: w for s, (w, _) in own.items()}), blocks), blocks)
    assert [slot for slot, _ in found] == list(range(sum(blocks.values())))
    assert Counter(s for _, s in found) == Counter({s: n for s, n in blocks.items() if n})
    order = [own[s][0] > 0 for _, s in found]
    assert order == sorted(order, reverse=True)


def test_fine_weights_make_blocks_larger(spark):
    """No weight is rounded; each source stays within one block of its exact share."""
    weights = {"a": 0.1234567890123, "b": 0.8765432109877}
    docs = spark.range(60_000).selectExpr("id as doc_id", "if(id < 8000, 'a', 'b') as source")
    rows = schedule(docs, weights, block_docs=2, most=2000).orderBy("slot", "nth").collect()
    assert len({(r.source, r.doc_id) for r in rows}) == 60_000
    size = 1 + max(r.nth for r in rows)
    assert size == 32 and len({r.slot for r in rows}) <= 2000
    own, served = exact_parts(weights), Counter()
    order = list(dict.fromkeys((r.slot, r.source) for r in rows if r.phase == 0))
    for t, (_, s) in enumerate(order, 1):
        served[s] += 1
        assert all(abs(served[x] - Fraction(t * own[x], sum(own.values()))) < 1 for x in own)
    with pytest.raises(TooManySlots):
        phases(exact_parts({"a": 0.123456789, "b": 1}), {"a": 10**9, "b": 10**9}, 1000)

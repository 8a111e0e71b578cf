from collections import Counter

import numpy as np
import pytest

from sedimark.llm.mixing import draw_counts, mix, permute, permute_all, share_out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permute_is_a_permutation(size):
    assert sorted(permute(i, size, 12345) for i in range(size)) == list(range(size))
    if size > 50:
        assert [permute(i, size, 1) for i in range(20)] != [permute(i, size, 2) for i in range(20)]


def test_draws_are_repeatable_and_whole():
    w = np.array([0.5, 0.3, 0.15, 0.05])
    total = np.zeros(4)
    for shard in range(200):
        c = draw_counts(w, 97, shard, 3)
        assert c.sum() == 97 and (c == draw_counts(w, 97, shard, 3)).all() and (abs(c - w * 97) <= 4).all()
        total += c
    assert abs(total / total.sum() - w).max() < 0.01


def docs(spark, n=300):
    rows = [(i, f"document {i} of many words " + "lorem " * (i % 50), "big" if i % 3 else "mid", None) for i in range(n)]
    rows += [(1000 + i, "tiny text", "small", None) for i in range(10)] + [(2000, None, "big", None), (2001, "", "mid", None), (2002, "no source", None, None), (2003, "other", "unlisted", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")


def test_shares_caps_and_blocks(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.38, 2), ("small", 0.02, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs(spark), targets, block_tokens=16, shard_blocks=64)
    rows = mixed.collect()
    used = Counter((r["source"], r["block"]) for r in rows)
    caps = {"big": 1, "mid": 2, "small": 3}
    assert rows and all(n <= caps[s] for (s, _), n in used.items())
    per_doc = Counter((r["source"], d, r["pass"]) for r in rows for d in set(r["doc_ids"]))
    assert max(p for _, _, p in per_doc) <= 3
    assert all(len(r["tokens"]) == r["n_tokens"] <= 16 for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    shares = {r["source"]: r for r in report.collect()}
    assert set(shares) == {"big", "mid", "small", "absent"} and shares["absent"]["actual_share"] == 0
    for s, want in (("big", 0.6), ("mid", 0.38), ("small", 0.02)):
        assert abs(shares[s]["actual_share"] - want) < 0.03
    again = {(r["shard"], r["slot"], r["source"], r["block"]) for r in mix(docs(spark), targets, block_tokens=16, shard_blocks=64)[0].collect()}
    assert again == {(r["shard"], r["slot"], r["source"], r["block"]) for r in rows}


def test_capped_source_falls_short_and_is_reported(spark):
    targets = spark.createDataFrame([("big", 0.5, 5), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs(spark), targets, block_tokens=8, total_tokens=4000)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["mix_tokens"] == got["small"]["source_tokens"] and got["small"]["actual_share"] < 0.1


def test_empty_tables(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs(spark).limit(0), targets)
    assert mixed.count() == 0 and report.count() == 1
    mixed, report = mix(docs(spark), targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_permute_all_is_permute():
    sizes = np.array([1, 2, 7, 64, 1000, 4097, 5, 5])
    index = np.array([0, 1, 3, 60, 999, 4096, 0, 4])
    keys = np.array([1, 2, 3, 4, 5, 6, 1 << 40, 7])
    assert permute_all(index, sizes, keys).tolist() == [permute(int(i), int(n), int(k)) for i, n, k in zip(index, sizes, keys)]


def test_what_is_drawn_beyond_a_cap_is_given_to_others():
    assert share_out(10, np.array([0, 100, 3]), np.array([0.5, 0.3, 0.2])).tolist() == [0, 7, 3]
    assert share_out(10, np.array([0, 2, 3]), np.array([0.5, 0.3, 0.2])).tolist() == [0, 2, 3]
    assert share_out(0, np.zeros(0, dtype=int), np.zeros(0)).tolist() == []


def test_no_slot_stays_empty(spark):
    targets = spark.createDataFrame([("big", 0.6, 1), ("big", 0.1, 9), ("mid", 0.38, 2), ("small", 0.02, 3)], "source string, target_share double, max_repeats int")
    for run_shards in (1, 3):
        mixed, report = mix(docs(spark), targets, block_tokens=4, shard_blocks=32, run_shards=run_shards)
        rows = mixed.collect()
        slots = {(r["shard"], r["slot"]) for r in rows}
        last = max(s for s, _ in slots)
        assert len(slots) == len(rows) and all((s, i) in slots for s in range(last) for i in range(32))
        assert Counter((r["source"], r["block"], r["pass"]) for r in rows).most_common(1)[0][1] == 1
        assert {r["source"]: r["max_repeats"] for r in report.collect()}["big"] == 1


def test_blocks_hold_every_token_once(spark):
    from sedimark.llm.bpe import encode_table
    from sedimark.llm.mixing import blocks_of

    encoded = encode_table(docs(spark), keep=("source",)).where("source in ('big', 'mid', 'small')")
    blocks, counts = blocks_of(encoded, "doc_id", "source", 7, 200)
    rows = blocks.collect()
    want = Counter(t for r in encoded.collect() for t in r["ids"])
    assert Counter(t for r in rows for t in r["tokens"]) == want
    for source, (tokens, n) in counts.items():
        own = [r for r in rows if r["source"] == source]
        assert sorted(r["block"] for r in own) == list(range(n)) and sum(r["n_tokens"] for r in own) == tokens
    assert {d for r in rows for d in r["doc_ids"]} == {str(r["doc_id"]) for r in encoded.where("n_tokens > 0").collect()}

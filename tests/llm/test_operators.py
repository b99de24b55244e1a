"""Each operator against a brute-force version on a small table with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import registry
from tessera.llm.exact_dedup import CuckooIndex, dedup_report, drop_copies
from tessera.llm.language import PpmModel, filter_languages, predict_languages
from tessera.llm.mixing import leaf_budgets, mix_documents, mix_report, share_out
from tessera.llm.near_dups import choose_depths, drop_near_duplicates, near_duplicates
from tessera.llm.packing import ChunkEncoder, best_fills, fit_patterns, nnls, pack_documents, plan_sequences, token_pieces
from tessera.llm.privacy import Pseudonymizer, luhn, permute, pseudonymize, unpermute
from tessera.llm.quality import judge_quality
from tessera.llm.sharding import assign_shards, shard_documents
from tessera.llm.substrings import drop_repeats
from tests.llm.conftest import rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(r[0], r[1]) for r in rows()]


def split(text):
    return WORD.findall(text or "")


def by_id(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["doc_id"]].append(r)
    assert sum(map(len, found.values())) == len(TEXTS)
    return found


# --- 1 sharding


def test_shards(docs):
    out = shard_documents(docs)
    found = by_id(out)
    slots = defaultdict(list)
    for doc, text in TEXTS:
        raw = (text or "").encode()
        for r in found[doc]:
            assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
            assert r["grown_shard"] in (r["shard"], 40)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_the_least_scores(spark):
    """The winning shard again, from the hashes alone."""
    import math

    from pyspark.sql import functions as F

    weights = [1.0, 3.0, 0.0, 0.5, 2.0]
    keys = spark.createDataFrame([(str(i),) for i in range(300)] + [(None,)], "k string")
    hashed = keys.select("k", F.array(*[F.xxhash64(F.xxhash64(F.coalesce("k", F.lit("\0null"))), F.lit(j).cast("long")) for j in range(6)]).alias("h"))
    want = {}
    for r in hashed.collect():
        unit = [((h % (1 << 64) >> 11) + 0.5) / 2**53 for h in r["h"]]
        score = [-math.log(u) / w if w else math.inf for u, w in zip(unit, [*weights, sum(weights) / 5], strict=True)]
        want[r["k"]] = (score.index(min(score[:5])), score.index(min(score)))
    got = assign_shards(keys, "k", 5, weights).collect()
    assert {r["k"]: (r["shard"], r["grown_shard"]) for r in got} == want


def test_shards_keep_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "doc_id long, `__scores` string, kept int")
    out = assign_shards(rows, "doc_id", 4, out="place")
    assert out.columns == ["doc_id", "__scores", "kept", "place", "grown_place"] and {r["__scores"] for r in out.collect()} == {"a", "b"}


def test_shards_follow_weights(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    n = Counter(r["shard"] for r in assign_shards(keys, "k", 3, [1.0, 2.0, 0.0]).collect())
    assert n[2] == 0 and 0.47 < n[0] / n[1] < 0.53
    with pytest.raises(ValueError):
        assign_shards(keys, "k", 2, [0.0, 0.0])


def test_new_shard_takes_only_its_share(spark):
    moved = [r for r in assign_shards(spark.range(20000).withColumnRenamed("id", "k"), "k", 9).collect() if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 9 for r in moved) and 1700 < len(moved) < 2300


# --- 2 mixing


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 1000.0), ("b", "x", 30.0), ("b", "y", 20.0)], "dom string, lang string, cap double")
    weights = {"dom": {"a": 1.0, "b": 1.0}, "lang": {"x": 3.0, "y": 1.0}}
    from pyspark.sql import functions as F

    got = {(r["dom"], r["lang"]): r["budget"] for r in leaf_budgets(leaves, ["dom", "lang"], weights, F.lit(200.0), 1.0).collect()}
    # b can use 50 of its 100, so a gets 150; there x is capped at 10 and y takes the rest
    assert got == {("a", "x"): 10.0, ("a", "y"): 140.0, ("b", "x"): 30.0, ("b", "y"): 20.0}


def fair_budgets(leaves, weights, budget):
    """Budgets of a tree by the definition: at each node, find the level at which the children, each taking weight times
    level but no more than all below them can use, take the node's budget."""
    leaves = {path: cap for path, cap in leaves.items() if all(weights[i].get(v, 1.0) > 0 for i, v in enumerate(path))}
    out = {}

    def give(prefix, amount):
        children = sorted({p[len(prefix)] for p in leaves if p[: len(prefix)] == prefix and len(p) > len(prefix)})
        if not children:
            out[prefix] = amount
            return
        caps = {c: sum(cap for p, cap in leaves.items() if p[: len(prefix) + 1] == (*prefix, c)) for c in children}
        w = {c: weights[len(prefix)].get(c, 1.0) for c in children}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(caps[c], w[c] * mid) for c in children) < amount else (lo, mid)
        for c in children:
            give((*prefix, c), min(caps[c], w[c] * lo))

    give((), min(budget, sum(leaves.values())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_of_trees_with_weight_zero(spark, seed):
    import random

    from pyspark.sql import functions as F

    r = random.Random(seed)
    leaves = {(d, g, s): float(r.choice([0, 5, 40, 300])) for d in "abc" for g in "xy" for s in "pq" if r.random() < 0.8}
    leaves |= {("a", "x", "p"): 10.0, ("a", "y", "p"): 90.0, ("b", "x", "p"): 100.0}
    weights = [{"a": 1.0, "b": 2.0, "c": 0.0 if seed % 2 else 1.0}, {"x": 1.0, "y": 0.0 if seed < 2 else 3.0}, {"p": 1.0, "q": 0.0 if seed == 3 else 0.5}]
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "d string, g string, s string, cap double")
    for budget in (100.0, 50.0, 5000.0):
        want = fair_budgets(leaves, weights, budget)
        got = {(x["d"], x["g"], x["s"]): x["budget"] for x in leaf_budgets(df, ["d", "g", "s"], dict(zip("dgs", weights, strict=True)), F.lit(budget), 1.0).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-2) for k in want)
        assert sum(got.values()) == pytest.approx(min(budget, sum(leaves[k] for k in want)), abs=0.1)


def test_share_out_is_water_filling(spark):
    caps, weights, budget = [5.0, 100.0, 8.0, 40.0], [1.0, 2.0, 3.0, 1.0], 60.0
    df = spark.createDataFrame([("p", f"n{i}", c, w, budget) for i, (c, w) in enumerate(zip(caps, weights, strict=True))], "parent string, node string, cap double, weight double, budget double")
    got = {r["node"]: r["budget"] for r in share_out(df, ["parent"]).collect()}
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, w * mid) for c, w in zip(caps, weights, strict=True)) < budget else (lo, mid)
    for i, (c, w) in enumerate(zip(caps, weights, strict=True)):
        assert got[f"n{i}"] == pytest.approx(min(c, w * lo), abs=1e-2)


def test_mix_keeps_to_budgets_and_is_a_prefix(docs):
    out = mix_report(docs, budget_ratio=0.7, max_epochs=2).collect()
    assert len(out) == len(TEXTS)
    words = {doc: len(split(t)) for doc, t in TEXTS}
    taken, budget = Counter(), {}
    for r in out:
        leaf = (r["domain"], r["lang"], r["source"])
        assert r["n_tokens"] == words[r["doc_id"]]
        taken[leaf] += r["epochs"] * r["n_tokens"]
        budget[leaf] = r["leaf_budget"]
    assert all(taken[k] <= budget[k] + 1e-6 for k in budget)
    assert sum(budget.values()) == pytest.approx(0.7 * sum(words[d] for d, _ in TEXTS), rel=1e-3)
    again = mix_report(docs, budget_ratio=0.7, max_epochs=2).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_mix_documents_takes_what_the_report_says(docs):
    want = Counter()
    for r in mix_report(docs, budget_ratio=1.5, max_epochs=3).collect():
        want[r["doc_id"]] += r["epochs"]
    got = mix_documents(docs, budget_ratio=1.5, max_epochs=3)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == +want


# --- 3 near duplicates


def jaccard_links(texts):
    def shingles(w):
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = dict(texts)
    sets = {i: shingles(split(t)) for i, t in sets.items()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    return links


def brute_classes(rows, width=5, threshold=0.8):
    """(doc_id, class_id, copy_id, n_links) of each row (doc_id, text), by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                parent[root(i)] = root(j)
    least, copy = {}, {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
        copy[sets[i]] = min(copy.get(sets[i], doc), doc)
    return sorted((doc, least[root(i)], copy[sets[i]] if sets[i] else doc, degree[i]) for i, (doc, _) in enumerate(rows))


def test_near_duplicates(docs):
    want = brute_classes(TEXTS)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(doc for doc, name, *_ in want if doc == name)


def edited(words, *at):
    w = list(words)
    for i in at:
        w[i] = f"new{i}"
    return " ".join(w)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    x, y = words(120, 5, 9000), words(120, 6, 9000)
    rows = [(1, edited(x)), (2, edited(y)), (7, edited(x, 119)), (7, edited(y, 0)), (7, edited(x, 119)), (9, "lone words that nobody else has at all"), (8, edited(y, 119)), (2, "another text of two without any double")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(table).collect())) == brute_classes(rows)
    kept = sorted(map(tuple, drop_near_duplicates(table).collect()))
    assert kept == sorted([rows[0], rows[1], rows[5], rows[7]])


def test_null_ids_stay(spark):
    x = edited(words(120, 5, 9000))
    table = spark.createDataFrame([(None, x), (None, x), (3, x), (4, x), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(table).collect())) == [(3, 3, 3, 1), (4, 3, 3, 1), (5, 5, 5, 0), (6, 6, 6, 0)]
    assert sorted((r["doc_id"] or 0) for r in drop_near_duplicates(table).collect()) == [0, 0, 3, 5, 6]


def test_large_nodes_and_tiles_lose_no_link(spark, monkeypatch):
    from tessera.llm import near_dups

    monkeypatch.setattr(near_dups, "TILE_SHINGLES", 1300)
    monkeypatch.setattr(near_dups, "LEAST_LOAD", 1)
    monkeypatch.setattr(near_dups, "NODE_BLOCKS", 3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, (7 * i) % 150)) for i in range(120)] + [(500 + i, edited(base, i)) for i in (3, 70)]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_classes(rows)


def test_small_sets_at_the_threshold(spark):
    rows = [(n, passage("s", n + 4)) for n in range(1, 14)] + [(20 + n, passage("s", n + 4) + " end") for n in range(1, 14)]
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999999).collect())) == brute_classes(rows)


def test_components_of_a_long_chain(spark):
    from tessera.llm.graph import components

    edges = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(200) if i != 99], "u binary, v binary")
    found = {bytes(r["node"]): bytes(r["component"]) for r in components(edges).collect()}
    assert found == {f"{i:03d}".encode(): b"000" if i < 100 else b"100" for i in range(201)}


def test_depths_reach_the_recall():
    depths = choose_depths({(0, 5): 1e9}, 0.8, 0.9999)
    assert np.prod([1 - 0.8**d for d in depths]) <= 1e-4
    assert depths[0] == max(depths)  # the tree whose shortening is dear keeps its long prefix


# --- 4 packing


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(registry.word_tokenizer())
    out = pack_documents(docs.dropDuplicates(["doc_id"]), registry.word_tokenizer()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for doc, text in dict(TEXTS).items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))
        ]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


def test_chunks_have_the_whole_text_s_ids():
    encoder = ChunkEncoder(registry.word_tokenizer())
    for text in ["Don't STOP it's 12ab é-È's ½x ǆ Straße", "a<|endoftext|>b", "’tis “quoted” — naïve", "éte  x y ΣΑΣ"]:
        want = encoder.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(3)
    for top in (300, 2000, 4096):
        h = Counter(int(x) for x in rng.integers(1, top + 1, 3000))
        plan, used, by_patterns = plan_sequences(h)
        assert used <= plan_sequences(h, shorts=[1.0])[1] and 0 <= by_patterns <= sum(h.values())
        seen, room = Counter(), defaultdict(int)
        for length, lo, hi, each, first, at in plan:
            for r in range(lo, hi):
                seen[length, r] += 1
                room[first + (r - lo) // each] += length
        assert seen == Counter({(k, i): 1 for k, n in h.items() for i in range(n)})
        assert max(room.values()) <= 4096 and len(room) == used
        assert used <= 1.03 * sum(k * n for k, n in h.items()) / 4096 + 2 or top == 4096


def test_most_pieces_are_placed_by_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    h = {r["length"]: r["count"] for r in token_pieces(docs, registry.word_tokenizer()).groupBy("length").count().collect()}
    _, used, by_patterns = plan_sequences(h)
    assert by_patterns > 0.5 * sum(h.values())
    assert used <= plan_sequences(h, shorts=[1.0])[1]


def test_patterns_fit_and_hold_every_class():
    total = np.random.default_rng(2).integers(0, 500, 32).astype(float)
    fitted = fit_patterns(total, 6, 6)
    assert all(1 <= len(p) <= 6 and sum(p) <= 32 and n > 0 for p, n in fitted)
    made = np.zeros(32)
    for p, n in fitted:
        for c in p:
            made[c - 1] += n
    assert np.allclose(made, total, atol=1e-3)


def test_best_fills_is_a_knapsack():
    from itertools import combinations_with_replacement

    values = np.random.default_rng(4).integers(-3, 20, 9).astype(float)
    best, _ = best_fills(values, 9, 3)
    for room in range(10):
        want = max(sum(values[c - 1] for c in p) for k in range(4) for p in combinations_with_replacement(range(1, 10), k) if sum(p) <= room)
        assert best[3, room] == max(want, 0)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers

    text = "Don't STOP  it's\n12ab é-È's ½x ǆ Straße <|endoftext|> twice  blank"
    for path in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = ChunkEncoder(public_tokenizers.path(path))
        assert encoder.by_chunk == (path == "word_bpe_49k.json")
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids
    changed = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    changed["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(changed))
    encoder = ChunkEncoder(str(tmp_path / "cased.json"))
    assert not encoder.by_chunk and np.frombuffer(encoder.encode(b"Stop it"), "<u4").tolist() == encoder.whole.encode("Stop it", add_special_tokens=False).ids


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 8)), np.array([0, 1, 0, 2, 0, 0, 3, 0.5])
    assert np.allclose(nnls(a, a @ x), x, atol=1e-6)
    b = rng.random(20) - 0.5
    got = nnls(a, b)
    gradient = a.T @ (b - a @ got)
    assert (got >= 0).all() and (gradient[got == 0] <= 1e-6).all() and np.allclose(gradient[got > 0], 0, atol=1e-6)


# --- 6 privacy


def test_permutation_is_one_to_one():
    for size in (2, 10, 37, 1000):
        assert sorted(permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_pseudonyms_keep_their_form():
    p = Pseudonymizer(b"key")
    text = "Mail Ana.Lopez7@mail.example.com, card 4111 1111 1111 1111 or 4111111111111111, no card 4111111111111112, call +1 (415) 555-0134, 10.0.0.255, 300.1.1.1, born 29.02.2000 or 2001-02-30, 123-45-6789, 000-12-3456, DE89370400440532013000"
    new, n = p.text(text)
    assert (n["email"], n["card"], n["phone"], n["ip"], n["date"], n["ssn"], n["iban"]) == (1, 2, 1, 1, 1, 1, 1)
    assert "4111111111111112" in new and "300.1.1.1" in new and "2001-02-30" in new and "000-12-3456" in new
    spaced, plain = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", new).groups()
    assert luhn(plain) and spaced.replace(" ", "") == plain != "4111111111111111"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and "555-0134" not in new
    assert p.text(text)[0] == new and Pseudonymizer(b"other").text(text)[0] != new


@pytest.mark.parametrize("phone", ["+49 30 1234567", "06 12 34 56 78", "06.12.34.56.78", "0612345678", "0151 23456789", "030/1234567", "(030) 123 45 67", "612 345 678", "612 34 56 78", "+33 6 12 34 56 78", "+49 (0)30 1234567", "0049 30 1234567", "0049301234567", "+34 612 345 678", "+493012345678", "+44 20 7946 0958"])
def test_phone_forms(phone):
    p = Pseudonymizer(b"key")
    new, n = p.text(f"Call {phone}, or (call {phone}).")
    assert n["phone"] == 2 and sum(n.values()) == 2 and phone not in new
    made = re.fullmatch(r"Call (.*), or \(call (.*)\)\.", new).groups()
    assert made[0] == made[1] and re.sub("[0-9]", "9", made[0]) == re.sub("[0-9]", "9", phone)
    assert p.text(f"Call {made[0]}.")[1]["phone"] == 1  # valid again


def test_values_after_a_phone():
    p = Pseudonymizer(b"key")
    alone = [p.text(x)[0] for x in ("+1 (826) 555-4081", "+49 30 1234567", "06 12 34 56 78", "030 1234567")]
    for phone, made in zip(("+1 (826) 555-4081", "+49 30 1234567", "06 12 34 56 78", "030 1234567"), alone, strict=True):
        for other, kind in (("190.137.223.204", "ip"), ("2024-05-01", "date"), ("1.5.2024", "date"), ("123-45-6789", "ssn"), ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("0123456789" * 4, "token")):
            new, n = p.text(f"{phone} {other}")
            assert n["phone"] == 1 and n[kind] == 1 and new == f"{made} {p.text(other)[0]}", (phone, other)
    assert p.text("+1 (826) 555-4081 2024")[0] == alone[0] + " 2024" and p.text("06 12 34 56 78 12 times")[0] == alone[2] + " 12 times"


def test_numbers_that_are_no_phones():
    text = "0 190.300.223.204, 0 12 345 678 91, 0.123456789, 3,0123456789, 00000000000, 1 612 345 678, 612 345 678 901, 12 345 6789, 123456789, 2019-2020, 1.234.567,89, v0.12.34, 1234567890123"
    assert Pseudonymizer(b"key").text(text)[0] == text


def test_dates_before_a_time():
    new, n = Pseudonymizer(b"key").text("at 2024-05-01T10:00:00Z, 2024-05-01t1000, 2024-05-01Z and 2024-05-01, not 2024-05-01Tuesday")
    assert n["date"] == 4 and sum(n.values()) == 4
    assert re.fullmatch(r"at (\d{4}-\d\d-\d\d)T10:00:00Z, \1t1000, \1Z and \1, not 2024-05-01Tuesday", new) and "2024-05-01T10" not in new


def test_unpermute_turns_back():
    for size in (1, 2, 37, 1000, 10**15):
        for value in (0, size // 3, size - 1):
            assert unpermute(permute(value, size, b"k", "t"), size, b"k", "t") == value


def test_pseudonymize_leaves_texts_without_personal_data(docs):
    found = by_id(pseudonymize(docs, b"k"))
    for doc, text in TEXTS:
        assert all(r["text"] == text for r in found[doc])


#: Valid values by kind, and values that look like some kind and are not valid for it.
PLANTED = {
    "email": ["ana.lopez@mail.example.com", "j_doe+x@host.org"],
    "ip": ["10.0.0.255", "192.168.17.4"],
    "phone": ["+1 (415) 555-0134", "+49 30 1234567", "06 12 34 56 78"],
    "card": ["4111 1111 1111 1111", "5500005555555559", "3782 822463 10005"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ssn": ["123-45-6789", "856-45-6789"],
    "date": ["29.02.2000", "2001-12-30", "12/31/1999"],
    "token": ["0123456789abcdef0123456789abcdef"],
}
REFUSED = ["4111111111111112", "300.1.1.1", "2001-02-30", "000-12-3456", "DE89370400440532013001", "12.13.1850"]


def valid(kind, value):
    """Whether a value is valid for its kind, by a plain check."""
    import datetime as dt

    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
        return total % 10 == 0
    if kind == "iban":
        plain = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "date":
        for form in ("%d.%m.%Y", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                return 1900 <= dt.datetime.strptime(value, form).year <= 2099
            except ValueError:
                pass
        return False
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "ssn":
        a, g, n = map(int, value.split("-"))
        return 0 < a < 900 and a != 666 and g > 0 and n > 0
    return True


def test_pseudonymize_planted_values(spark):
    """Each value alone, several in a text, the same value in many documents and places, and invalid ones."""
    key, rows = b"a test key", []
    values = [(k, v) for k, vs in PLANTED.items() for v in vs]
    for i, (_, v) in enumerate(values):
        rows += [(i, f"Start {v}, and (again {v}) end."), (100 + i, f"über {v}\nnext line")]
    everything = " | ".join(v for _, v in values)
    rows += [(300, everything), (301, "keep " + " | ".join(REFUSED)), (302, None), (303, ""), (303, everything), (None, everything)]
    out = {}
    for r in pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), key).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    made = {}
    for i, (kind, v) in enumerate(values):
        new = re.fullmatch(r"Start (.*), and \(again (.*)\) end\.", out[i][0]["text"]).groups()
        assert new[0] == new[1] != v and out[100 + i][0]["text"] == f"über {new[0]}\nnext line"
        assert out[i][0][f"n_{kind}"] == 2 and sum(out[i][0][f"n_{k}"] for k in PLANTED) == 2
        assert valid(kind, v) and valid(kind, new[0])
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new[0]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))) or kind in ("ip", "email", "token")
        made[kind, v] = new[0]
    assert len(set(made.values())) == len(made)
    whole = " | ".join(made[x] for x in values)
    assert out[300][0]["text"] == whole == out[None][0]["text"] and {r["text"] for r in out[303]} == {"", whole}
    assert out[301][0]["text"] == "keep " + " | ".join(REFUSED) and out[302][0]["text"] is None
    p = Pseudonymizer(key)
    v = int.from_bytes(bytes(map(int, made["ip", "10.0.0.255"].split("."))), "big")
    assert unpermute(v, 1 << 32, p.key, "ip") == int.from_bytes(bytes([10, 0, 0, 255]), "big")
    body = made["card", "5500005555555559"][:-1]
    assert unpermute(int(body), 10**15, p.key, "card15") == int("550000555555555")


def test_equal_numbers_stay_equal_in_other_forms(spark):
    p = Pseudonymizer(b"key")
    spaced, plain, dashed = (p.text(x)[0] for x in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"))
    assert spaced.replace(" ", "") == plain == dashed.replace("-", "")
    days = [p.text(x)[0] for x in ("29.02.2000", "2000-02-29", "2000/02/29")]
    assert days[0].split(".")[::-1] == days[1].split("-") == days[2].split("/")


# --- 7 exact dedup


def test_cuckoo_index():
    index, live = CuckooIndex(8), {}
    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, x in enumerate(digests):
        assert index.get(x) is None
        index.insert(x, i)
        live[x] = i
        if i % 3 == 0:
            gone = digests[i // 2]
            assert index.delete(gone) == (gone in live)
            live.pop(gone, None)
    assert index.resizes > 0 and index.size == len(live) and dict(index.items()) == live
    assert all(index.get(x) == live.get(x) for x in digests)
    assert not index.delete(b"\0" * 32)


def test_dedup(docs):
    groups = defaultdict(list)
    for doc, text in TEXTS:
        groups[text or ""].append(doc)
    found = by_id(dedup_report(docs))
    for doc, text in TEXTS:
        own = groups[text or ""]
        for r in found[doc]:
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(own), len(own), doc == max(own), hashlib.sha256((text or "").encode()).hexdigest())
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_drop_copies_of_repeated_rows(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "b", 4), (2, "b", 4), (None, "c", 5), (None, "c", 6), (None, "d", 7), (3, "d", 8), (4, None, 9), (5, "", 10), (None, "e", 11)]
    kept = drop_copies(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (5, ""), (None, "e")])


def test_tables_are_swept(spark):
    import os

    from tessera.llm.common import stash, stashed, sweep

    mark = stashed(spark)
    paths = [stash(spark.range(3), "swept").inputFiles()[0][7:] for _ in range(3)]
    sweep(spark, mark, keep_last=True)
    assert [os.path.exists(p) for p in paths] == [False, False, True] and stashed(spark) == mark + 1
    sweep(spark, mark)
    assert not os.path.exists(paths[2])


def test_dedup_null_ids(spark):
    out = dedup_report(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (None, "b")], "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out) == Counter({(None, 3, 2, False): 1, (3, 3, 2, True): 1, (None, None, 2, True): 2})


# --- 8 language


def plain_cost(samples, text, order=3):
    """Bits of a text by the definition, with dictionaries."""
    counts = defaultdict(Counter)
    for s in samples:
        s = b"\n" * order + s
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    text, bits = b"\n" * order + text, 0.0
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if text[i] in seen:
                bits -= np.log2(seen[text[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"the hat"], "b": ["le chat est là où".encode(), b"le"]}
    model = PpmModel(samples)
    texts = [b"the chat", "où là!".encode(), b"", b"zzz the", "the cat là ".encode() * 40]
    got = model.code_lengths(texts, slice_bytes=64)
    for i, t in enumerate(texts):
        for j, k in enumerate(model.langs):
            assert got[i, j] == pytest.approx(plain_cost(samples[k], t), rel=1e-5, abs=1e-4)


def test_languages(docs):
    found = by_id(predict_languages(docs))
    for doc, text in TEXTS:
        for r in found[doc]:
            assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r["score"] <= 1
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    kept = filter_languages(docs)
    assert kept.columns == docs.columns
    lettered = {d for d, t in TEXTS if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in kept.collect()} == lettered - {30}  # its bytes are in none of the languages learned here


def test_languages_of_rows_without_ids(spark):
    rows = [(None, "la casa es grande y la calle es larga", "es"), (None, "123", "es"), (1, "la calle", "es"), (2, "the house", "en"), (3, "la casa", "es"), (4, "the street", "en")]
    out = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()
    assert len(out) == 6 and sorted((r["lang_pred"], r["held_out"]) for r in out if r["doc_id"] is None) == [("es", False), ("und", False)]
    nameless = predict_languages(spark.createDataFrame([(None, "x", "es"), (None, "y z", "es")], "doc_id long, text string, lang string")).collect()
    assert [r["lang_pred"] for r in nameless] == ["und", "und"]  # nothing to learn from


def test_languages_without_labels(spark):
    out = predict_languages(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")).collect()
    assert out[0]["lang_pred"] == "und"


def test_every_language_is_learned(spark):
    from tessera.llm.language import held_out

    letters = "abcdefghijklmnop"
    ids = [r["id"] for r in spark.range(1200).filter(~held_out("id")).collect()]
    rows = [(ids.pop(), f"{letters[k // 16]}{letters[k % 16]}{letters[k * 7 % 16]} " * 30, f"x{k:03d}") for k in range(205) for _ in range(2)]
    rare = "qué wünscht zyx "
    docs = spark.createDataFrame([*rows, (ids.pop(), rare * 30, "zz")], "doc_id long, text string, lang string")
    found = predict_languages(docs)
    assert [r["lang_pred"] for r in found.join(docs.filter("lang = 'zz'"), "doc_id").collect()] == ["zz"]
    assert found.join(docs, "doc_id").filter("lang_pred <> lang").count() == 0
    assert filter_languages(docs).count() == docs.count()


def test_blocks_of_languages_score_as_one_model(spark):
    from tessera.llm.language import identify

    samples = {"en": [b"the cat sat", b"the hat"], "fr": ["le chat là".encode(), b"ou le"], "de": [b"die katze", b"und der hut"]}
    docs = spark.createDataFrame([(1, "the hat and the cat"), (2, "le chat"), (3, "und die katze"), (4, "zzz"), (5, "")], "doc_id long, text string")
    share = spark.sparkContext.broadcast
    one = sorted(identify(docs, [share(PpmModel(samples))]).collect())
    many = sorted(identify(docs, [share(PpmModel({k: v})) for k, v in samples.items()]).collect())
    for a, b in zip(one, many, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_training_sample_is_bounded_in_bytes(spark):
    from tessera.llm.language import training_sample

    docs = spark.createDataFrame([(i, "äb" * 2000, "de") for i in range(3)] + [(9, "short", "en")], "doc_id long, text string, lang string")
    size = {r["lang"]: r["n"] for r in training_sample(docs, 300, 7001).selectExpr("lang", "octet_length(text) AS n").groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert size == {"de": 7001, "en": 5}


# --- 9 quality


def test_quality_base(docs):
    found = by_id(judge_quality(docs))
    for doc, text in TEXTS:
        w, t = split(text), text or ""
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeated = len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated)
        for r in found[doc]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (len(w) < 10 or 100 * repeated > 20 * len(w))
            assert not (r["base_failed"] and r["kept"])


def test_quality_distances(spark):
    plain = "the cat of the house and the dog in the garden is on the way to it " * 5
    good = [(i, " ".join(f"{w}{'' if k % 3 else i + k}" for k, w in enumerate(plain.split())), "en") for i in range(20)]
    odd = [(99, " ".join(f"@@{k}##" for k in range(100)), "en")]
    out = {r["doc_id"]: r for r in judge_quality(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()}
    assert not out[99]["kept"] and not out[99]["base_failed"] and out[99]["class_distance"] > max(out[i]["class_distance"] for i in range(20))
    assert all(0 <= r[c] <= 1 for r in out.values() for c in ("class_distance", "word_distance"))


def test_quality_counts_long_words(spark):
    usual = [(i, "nicht immer haben werden können " * 20 + f"wort{i}", "de") for i in range(10)]
    odd = [(99, " ".join(f"{a}{b}ngelo" for a in "abcdefghij" for b in "abcdefghij"), "de")]
    out = {r["doc_id"]: r["word_distance"] for r in judge_quality(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string")).collect()}
    assert out[99] > 0.45 > max(out[i] for i in range(10))


# --- 10 substrings


def brute_repeats(rows, least=50):
    """For each row (doc_id, text): the words, and the places that a window starting in a smaller doc_id covers."""
    low = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            low[key] = min(low.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = {j for i in range(len(w) - least + 1) if low[tuple(w[i : i + least])] < doc for j in range(i, i + least)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats(docs):
    out = drop_repeats(docs).collect()
    assert sorted(map(tuple, out)) == brute_repeats(TEXTS)
    assert sum(r["n_removed"] for r in out) > 200


def passage(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_repeats_of_one_id_with_several_texts(spark):
    p60, a40, b40 = passage("p", 60), passage("a", 40), passage("b", 40)
    rows = [(1, p60), (5, f"{p60} {a40}"), (5, f"{b40} {p60}"), (5, f"{b40} {p60}"), (7, f"{a40} {b40} {p60}"), (5, passage("q", 70)), (8, passage("q", 70)), (9, "x " + passage("q", 55))]
    out = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == brute_repeats(rows)


def test_repeats_without_ids(spark):
    rows = [(None, passage("p", 60)), (1, passage("p", 60)), (None, passage("p", 60)), (2, passage("p", 60))]
    out = sorted(map(tuple, drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [(r[0], r[2]) for r in out] == [(1, 0), (2, 60), (None, 0), (None, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_mixed_passages(spark, seed):
    import random

    r = random.Random(seed)
    pool = [passage(t, 150) for t in "abc"]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(pool).split()
            lo = r.randrange(0, 90)
            cut = w[lo : lo + r.randrange(30, 150)]
            if r.random() < 0.3 and cut:
                cut[r.randrange(len(cut))] = f"edit{i}"
            parts += [*cut, *(f"own{i}-{r.randrange(9)}" for _ in range(r.randrange(0, 3)))]
        rows.append((r.randrange(40), " ".join(parts)))
    rows.append((99, passage("loop", 5) + " " + " ".join(["same"] * 200)))
    rows.append((98, " ".join(["same"] * 120)))
    out = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == brute_repeats(rows)


def test_id_filter_lets_all_ids_pass(spark):
    from tessera.llm.idfilter import may_hold

    ids = spark.range(0, 30000, 3)
    table = spark.range(30000).withColumnRenamed("id", "k")
    for bits in (1 << 28, 1 << 16):
        found = {r["k"] for r in table.filter(may_hold(ids, "k", most_bits=bits)).collect()}
        assert set(range(0, 30000, 3)) <= found and (len(found) < 11000 or bits == 1 << 16)
    assert table.filter(may_hold(ids.limit(0), "k")).count() == 0


# --- empty tables


@pytest.mark.parametrize("operator", [shard_documents, mix_report, near_duplicates, lambda d: pack_documents(d, registry.word_tokenizer()), lambda d: pseudonymize(d, b"k"), dedup_report, predict_languages, judge_quality, drop_repeats, drop_copies, mix_documents, drop_near_duplicates, filter_languages])
def test_empty(empty, operator):
    assert operator(empty).count() == 0


# --- 2 mixing: tied rows


def taken_of(spark, rows, **options):
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "en", "src0") for i, n in rows], "doc_id long, text string, lang string, source string").repartition(3)
    return sorted(((r["doc_id"], r["n_tokens"], r["epochs"]) for r in mix_report(df, **options).collect()), key=str)


def test_repeated_rows_keep_the_budget(spark):
    """Rows of one doc_id, or without one, are a unit: together within the budget, or not at all."""
    assert taken_of(spark, [(1, 10), (1, 10)], budget_ratio=0.5, max_epochs=1) == [(1, 10, 0)] * 2
    assert taken_of(spark, [(1, 10), (1, 10)], budget_ratio=1.0, max_epochs=1) == [(1, 10, 1)] * 2
    assert taken_of(spark, [(None, 10)] * 4, budget_ratio=0.5, max_epochs=1) == [(None, 10, 0)] * 4
    assert taken_of(spark, [(None, 10)] * 4, budget_ratio=1.0, max_epochs=2) == [(None, 10, 1)] * 4


@pytest.mark.parametrize("ratio", [0.2, 0.5, 0.7, 0.9, 1.3])
def test_budgets_with_ties_against_brute_force(spark, ratio):
    r = random.Random(9)
    rows = [(r.choice([None, *range(25)]), r.randrange(1, 9)) for _ in range(60)]
    total = sum(n for _, n in rows)
    budget, full = total * min(ratio, 2), int(min(2, total * ratio // total))
    rest = budget - full * total
    place = {i: int(hashlib.md5(f"17/{full}/{'null' if i is None else i}".encode()).hexdigest()[:12], 16) for i, _ in rows}
    more, used = set(), 0
    for i in sorted(place, key=place.get):
        used += sum(n for j, n in rows if j == i)
        if used > rest:
            break
        more.add(i)
    assert taken_of(spark, rows, budget_ratio=ratio, max_epochs=2) == sorted(((i, n, full + (i in more)) for i, n in rows), key=str)

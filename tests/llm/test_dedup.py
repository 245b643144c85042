"""Exact, substring and near duplicates, and mixing, against brute force."""
from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from patronage.llm import exact_dedup, mixing, simhash, substring_dedup
from patronage.llm.queries import OP5_SQL, OP7_SQL
from tests.llm.frames import awkward, documents, empty, prose


def test_cuckoo_index_inserts_finds_deletes_and_resizes():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, [i, 1])
    assert index.resizes > 0 and index.size == 3000
    assert all(index.find(k)[0] == i for i, k in enumerate(keys))
    assert index.find(hashlib.sha256(b"no").digest()) is None
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]


def test_cuckoo_index_tells_keys_with_one_fingerprint_and_places_apart():
    same = [b"\x01\x00" + bytes(8) + i.to_bytes(22, "big") for i in range(40)]
    index = exact_dedup.CuckooIndex(4)
    for i, k in enumerate(same):
        index.insert(k, [i, 1])
    assert [index.find(k)[0] for k in same] == list(range(40))
    assert index.delete(same[7]) and index.find(same[7]) is None and index.find(same[8])[0] == 8


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append((r[0] is None, r[0] or 0, r[1] is not None, hashlib.sha256((r[1] or "").encode()).hexdigest(), r[0]))
    want = Counter()
    for text, found in groups.items():
        for place, r in enumerate(sorted(found, key=lambda x: x[:4])):
            want[(r[4], min((x[4] for x in found if x[4] is not None), default=None), len(found), place == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return want


def test_exact_duplicates_against_brute_force(spark):
    rows = awkward()
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(documents(spark)).collect()) == brute_exact(rows)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_group_stays_with_repeated_and_null_ids(spark):
    some = [(1, "a b"), (1, "a  b"), (1, "a  b"), (None, "z"), (None, "z"), (None, " "), (None, "\t"), (2, None), (2, ""), (3, "lone"), (None, "a b"), (4, "a b")]
    rows = [(*r, *[None] * 11) for r in some]
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(documents(spark, rows).repartition(5)).collect())
    assert got == brute_exact(rows)
    assert sum(n for r, n in got.items() if r[3]) == len({r[4] for r in got})


def test_live_index_takes_insertions_and_deletions(spark):
    rows = exact_dedup.digests(documents(spark, [(i, t, *[None] * 11) for i, t in enumerate(["a", "b", "a", "c"])]))
    index = exact_dedup.live_index(rows)
    gone = rows.where("doc_id = 1").select("digest")
    more = exact_dedup.digests(documents(spark, [(9, "c", *[None] * 11), (10, "d", *[None] * 11)]))
    after = exact_dedup.updated_index(index, added=more, deleted=gone)
    assert sorted((r["keep_id"], r["group_size"]) for r in after.collect()) == [(0, 2), (3, 2), (10, 1)]


def brute_removed(texts: list[bytes], length: int) -> list[bytearray]:
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        out.append(covered)
    return out


@pytest.mark.parametrize("length,seed_bytes,case", [(20, 8, 1), (24, 4, 2), (400, 64, 3)])
def test_substring_dedup_against_brute_force(spark, length, seed_bytes, case):
    rng = random.Random(case)
    if case == 3:
        texts = [r[1] for r in awkward()]
    else:
        parts = [prose(rng, rng.randint(3, 12)) for _ in range(12)]
        texts = ["".join(rng.choice(parts)[rng.randint(0, 9):rng.randint(15, 60)] for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["xy" * 40, "z" * 90, None, ""]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(documents(spark, [(i, t, *[None] * 11) for i, t in zip(ids, texts)]), length, seed_bytes).collect()}
    data = [(t or "").encode() for t in texts]
    for i, covered in enumerate(brute_removed(data, length)):
        kept = bytes(b for b, c in zip(data[i], covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        want = (len(data[i]), sum(covered), spans, hashlib.sha256(kept).hexdigest())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want, i
        assert (got[i]["text"], got[i]["n_chars"]) == (kept.decode("utf-8", "ignore"), len(kept.decode("utf-8", "ignore")))


def test_substring_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    rows = substring_dedup.without_repeats(documents(spark)).collect()
    assert len(rows) == len(awkward())
    alike = [r for r in rows if r["doc_id"] == 8]
    assert len(alike) == 3 and all(r["n_removed"] == r["n_bytes"] == len(awkward()[8][1]) for r in alike)
    assert substring_dedup.without_repeats(empty(spark)).count() == 0


def test_long_texts_are_ranked_in_chunks(monkeypatch):
    rng = random.Random(4)
    data = prose(rng, 400).encode()
    whole = [tuple(map(tuple, zip(*x))) for x in substring_dedup.runs_of(data, 40, 8)]
    monkeypatch.setattr(substring_dedup, "CHUNK", 100)
    pieces = [tuple(map(tuple, zip(*x))) for x in substring_dedup.runs_of(data, 40, 8)]
    windows = lambda parts: {(at - d, at, name) for p in parts for at, back, ahead, name in p for d in range(ahead, back + 1)}
    assert windows(whole) == windows(pieces) and len(windows(whole)) == len(data) - 39


def brute_print(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_prints_and_components_against_brute_force(spark):
    rows = awkward()
    rng = random.Random(8)
    base = prose(rng, 300).split()
    for i in range(60):  # near copies, each a word away from another
        copy = base[:]
        copy[rng.randrange(300)] = rng.choice(["alpha", "beta"])
        rows.append((100 + i, " ".join(copy), *[None] * 11))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute_print(r[1]) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{p:016x}") for r, p in zip(rows, prints))
    component = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            component[i] = min(component[j] for j, q in enumerate(prints) if bin(p ^ q).count("1") <= 2)
    least = {}
    for i, c in enumerate(component):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[i][0])
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], least.get(component[i])) for i, r in enumerate(rows))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_text_print_is_the_same_in_blocks(monkeypatch):
    text = prose(random.Random(1), 700)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == brute_print(text)


def test_tiles_find_all_links_and_groups_are_dealt_out(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for b in base for _ in range(30)]
    values = np.unique(np.array([*base, *flips], dtype=np.uint64))
    want = {(int(a), int(b)) for a in values for b in values if a < b and bin(int(a) ^ int(b)).count("1") <= 2}
    i, j = simhash.tile_links(values, values, 2, tile=16)
    assert {(int(values[a]), int(values[b])) for a, b in zip(i, j) if values[a] < values[b]} == want
    prints = spark.createDataFrame([(int(v.astype(np.int64)),) for v in values], "print long")

    def classes(edges):
        up = {int(v.astype(np.int64)): int(v.astype(np.int64)) for v in values}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in edges:
            up[top(a)] = top(b)
        return {frozenset(x for x in up if top(x) == t) for t in {top(x) for x in up}}

    signed = [(int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))) for a, b in want]
    found = [(r["a"], r["b"]) for r in simhash.links(prints, 2, group=7).collect()]
    assert classes(found) == classes(signed)


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def copy_groups(rows: list[tuple]) -> dict:
    """doc_id: smallest doc_id reachable over Jaccard similarities of 0.8 or more."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    low = {i: i for i in sets}
    alike = {i: [j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in sets}
    for _ in sets:
        after = {i: min(low[j] for j in alike[i]) for i in sets}
        if after == low:
            break
        low = after
    return low


def test_near_copies_against_brute_force(spark):
    rng = random.Random(21)
    rows = [r for r in awkward() if r[0] is not None]
    for g in range(12):
        base = prose(rng, rng.randint(60, 500)).split()
        for i in range(6):
            copy = [rng.choice(["alpha", "beta", "gamma"]) if rng.random() < 0.02 * i / 2 else w for w in base]
            rows.append((1000 + 10 * g + i, " ".join(copy), *[None] * 11))
    want = copy_groups(rows)
    for group in (4 * simhash.GROUP, 7):
        got = simhash.near_copies(documents(spark, rows), group=group).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], want[r[0]]) for r in rows)
    assert 12 < len(set(want.values())) < len(want) - 20
    assert simhash.near_copies(empty(spark)).count() == 0


def test_pairs_at_the_least_similarity_are_found_at_every_length(spark):
    rng = random.Random(77)
    rows = []
    for i in range(1500):
        n = (8, 16, 56, 200)[i % 4 if i % 3 else 0]
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        if i % 2 or n < 56:  # an ending of a quarter as many shingles
            other = [*words, *[f"w{rng.randrange(10**6)}" for _ in range((n - 4) // 4)]]
        else:  # a block of a ninth of the shingles, set anew
            k = (n - 4) // 9 - 4
            other = [*words[:20], *[f"w{rng.randrange(10**6)}" for _ in range(k)], *words[20 + k:]] if k > 0 else words[1:]
        assert 0.8 <= len(shingles(" ".join(words)) & shingles(" ".join(other))) / len(shingles(" ".join(words)) | shingles(" ".join(other))) < 1
        rows += [(2 * i, " ".join(words), *[None] * 11), (2 * i + 1, " ".join(other), *[None] * 11)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, rows)).collect()}
    assert {d: d // 2 * 2 for d in range(3000)} == got


def test_large_groups_of_near_copies_against_brute_force(spark):
    rng = random.Random(33)
    rows = []
    for family in range(3):
        one = prose(rng, 200).split()
        two = one[:90] + prose(rng, 20).split() + one[110:]
        for i in range(240):  # two groups at 0.775 between which only few pairs, the odd ones on both sides, are at 0.8
            words = (one, two)[i % 2][:]
            if i % 120 < 2:
                words[90:92], words[108:110] = two[90:92], one[108:110]
            rows.append((1000 * family + i, " ".join([*words, f"end{i}"]), *[None] * 11))
    rng.shuffle(rows)
    want = copy_groups(rows)
    assert set(want.values()) == {0, 1000, 2000}
    got = simhash.near_copies(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_crowded_texts_meet_in_small_groups_too():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 40)
    sets = [np.unique(np.where(rng.random(40) < 0.09, rng.integers(0, 2**62, 40), base)) for _ in range(120)]
    held = [(i, len(s), 0, 0, 0, 0, s, 0) for i, s in enumerate(sets)]
    alike = {(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}

    def classes(edges):
        low = np.arange(120)
        for _ in range(120):
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        return low.tolist()
    found = [e for out in simhash._confirmed((0, 0, 0, 0), held, 30, 0.8) for e in zip(out["a"], out["b"])]
    assert classes(found) == classes(alike) and 1 < len(set(classes(alike))) < 120
    halves = [(*row[:7], i % 2) for i, row in enumerate(held)]
    crossing = {(i, j) for i, j in alike if i % 2 != j % 2}
    found = [e for out in simhash._confirmed((0, 0, 0, 1), halves, 30, 0.8) for e in zip(out["a"], out["b"])]
    assert set((max(e), min(e)) for e in found) <= crossing and classes(found) == classes(crossing)


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = awkward()
    kept = simhash.keep_first(documents(spark)).collect()
    want = set(copy_groups(rows).values())
    assert Counter(r["doc_id"] for r in kept if r["doc_id"] is not None) == Counter(want)
    assert documents(spark).columns == simhash.keep_first(documents(spark)).columns
    assert len(rows) > len(kept)


def test_near_duplicate_stage_keeps_rows_without_id_and_other_texts_under_one_id(spark):
    rng = random.Random(12)
    one, two, three, four, five, six = (prose(rng, 80) for _ in range(6))
    rows = [(None, one), (None, two), (None, two + " tail"), (None, three), (None, three), (5, four), (6, five), (6, four + " tail"), (7, six), (7, six), (8, six + " tail"), (None, five + " tail")]
    rows = [(*r, *[None] * 11) for r in rows]
    kept = simhash.keep_first(documents(spark, rows)).collect()
    groups = Counter()
    for r in kept:
        groups[next(i for i, t in enumerate((one, two, three, four, five, six)) if r["text"].startswith(t)), r["doc_id"]] += 1
    assert groups == Counter({(0, None): 1, (1, None): 1, (2, None): 1, (3, 5): 1, (4, 6): 1, (5, 7): 1})


def duck_over(rows: list[tuple], sql: str) -> Counter:
    import duckdb
    import pandas as pd

    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": [r[1] for r in rows], "source": [r[3] for r in rows]})  # noqa: F841
    con = duckdb.connect()
    con.register("given", frame)
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM given")
    return Counter(con.execute(sql).fetchall())


def test_sql_of_mixing_and_exact_dedup_on_awkward_rows(spark):
    rows = awkward()
    got = mixing.mixed(documents(spark)).select("doc_id", "size", "source_size", "target", "taken", "copies")
    assert Counter(tuple(r) for r in got.collect()) == duck_over(rows, OP5_SQL)
    got = exact_dedup.exact_duplicates(documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(tuple(r) for r in got.collect()) == duck_over(rows, OP7_SQL)


def brute_targets(sizes: dict) -> dict:
    """Clamp and deal out again until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(held.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return held | {s: weight[s] * level for s in free}
        held |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [[40, 1, 1, 90, 3], [1, 1, 1000], [0, 0], [7], [5, 0, 800, 2, 2, 2, 600]])
def test_mixing_comes_near_its_targets(spark, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for k in range(size):
            rows.append((n, "w " * (1 + k % 3), None, f"s{s}" if s else None, *[None] * 9))
            n += 1
        if not size:
            rows.append((n, None, None, f"s{s}", *[None] * 9))
            n += 1
    out = mixing.mixed(documents(spark, rows)).collect()
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    taken = Counter()
    for r in out:
        total[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = brute_targets({s: total[s] for s in set(source.values())})
    for r in out:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2
    again = mixing.mixed(documents(spark, rows).repartition(3)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(documents(spark, rows)).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})


def test_rows_without_ids_are_taken_one_by_one(spark):
    rows = [(None if i % 2 else i, f"w{i} " * (i % 7 + 1), None, ("a", "b")[i % 3 == 0], *[None] * 9) for i in range(300)]
    got = mixing.mixed(documents(spark, rows).repartition(4))
    sql = Counter(tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken", "copies").collect())
    assert sql == duck_over(rows, OP5_SQL)
    target = {(r["target"], r["source_size"]) for r in got.collect()}
    taken = {t: sum(r["taken"] for r in got.where(F.col("target") == t[0]).collect()) for t in target}
    assert all(abs(v - t[0]) <= 7 for t, v in taken.items())
    mix = mixing.mix_documents(documents(spark, rows).repartition(4))
    copies = {"a": 0, "b": 0}
    for r in mix.collect():
        copies[r["source"]] += len(r["text"].split())
    assert sorted(copies.values()) == sorted(taken.values())


def test_mixing_of_nothing_and_of_awkward_columns(spark):
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mix_documents(empty(spark)).count() == 0
    out = mixing.mix_documents(documents(spark))
    assert out.columns == documents(spark).columns and out.count() > 0


def test_near_copies_hand_on_few_rows_at_any_group_size():
    """What a comparison hands on grows with its documents, not with their pairs; pairs with an open end are all there."""
    rng = np.random.default_rng(7)
    per_node = []
    for n in (2000, 4000, 8000):
        prints = [rng.integers(-(1 << 62), 1 << 62) ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 62, (n, 3)), axis=1) for _ in simhash.PRINTS]
        node = np.arange(n)
        out = list(simhash._nearest((5, 0, 0, 0), list(zip(node, np.full(n, 200), *prints, np.zeros(n, int))), simhash.RADIUS, 0.8))
        assert {a for o in out for a, b in zip(o["a"], o["b"]) if a == b} == set(range(n))  # all are crowded
        per_node.append(sum(len(o["a"]) for o in out) / n)
    assert max(per_node) <= 2
    # a crowd, and far from it a small group: its pairs are handed on
    lone = simhash.NEAREST // 2
    prints = [np.concatenate([np.zeros(300, np.int64), np.full(lone, (1 << 30) - 1, np.int64)]) for _ in simhash.PRINTS]
    node = np.arange(300 + lone)
    out = list(simhash._nearest((5, 0, 0, 0), list(zip(node, np.full(len(node), 200), *prints, np.zeros(len(node), int))), simhash.RADIUS, 0.8))
    pairs = {(min(a, b), max(a, b)) for o in out for a, b in zip(o["a"].tolist(), o["b"].tolist()) if a != b}
    assert pairs == {(a, b) for a in range(300, 300 + lone) for b in range(a + 1, 300 + lone)}

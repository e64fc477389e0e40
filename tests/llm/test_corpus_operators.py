"""Dedup, SimHash, mixing, token counts, tool calls and the pipeline against brute force."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, mixing, simhash, token_counts, tool_calls
from corpusloom.llm.common import numbered
from corpusloom.sources.scratch import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, gone_id int, size int"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3) for i, t, s in rows], DOCS)


# Exact dedup


def test_exact_dedup(spark):
    texts = ["a b", "a\t b", "a  b ", None, "", " ", "x", "a b", "é", "a b\x0b"]
    rows = [(100 - i, t, "s") for i, t in enumerate(texts)] + [(7, "same", "s"), (7, "same", "s"), (None, "same", "s"), (None, "only", "s")]
    got = exact_dedup.verdicts(docs(spark, rows)).collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    norms = {hashlib.sha256(norm(t).encode()).hexdigest(): norm(t) for _, t, _ in rows}
    for i, t, _ in rows:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    want = Counter()
    for key, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep and not keep_is_repeat, key) for i, keep_is_repeat in zip(ids, repeats(ids)))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.verdicts(docs(spark, rows).limit(0)).count() == 0
    left = exact_dedup.stage(spark, docs(spark, rows), "")
    assert left.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], norm(r["text"])) for r in left.collect()) == Counter((min((i for i in ids if i is not None), default=None), norms[key]) for key, ids in groups.items())


def repeats(ids):
    """Whether each id has come before."""
    return [i in ids[:k] for k, i in enumerate(ids)]


def test_dedup_stages_lose_no_text_where_rows_share_an_id(spark):
    rng = np.random.default_rng(8)
    long = [" ".join(rng.choice([f"w{i}" for i in range(900)], 300)) for _ in range(3)]
    for a, b, c in [("A", "B", "C"), long]:
        rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (5, b, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s")]
        for stage in (exact_dedup.stage, simhash.stage):
            left = stage(spark, docs(spark, rows), "").collect()
            assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted([("1", a), ("5", b), ("None", c)])
            assert stage(spark, docs(spark, []), "").count() == 0


def test_dedup_of_a_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i} of its own", "s") for i in range(4000)]
    got = {r["doc_id"]: r for r in exact_dedup.verdicts(docs(spark, rows)).collect()}
    assert sum(r["kept"] for r in got.values()) == 1335 and got[3999]["kept"] and got[2]["keep_id"] == 1 and got[2]["group_size"] == 2666
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(prints) == 4000 and {prints[i]["component_id"] for i in range(4000) if i % 3} == {1}


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    h = exact_dedup.PerfectHash.build(words)
    assert sorted(h.slots(words)) == list(range(5000))
    back = exact_dedup.PerfectHash.from_bytes(h.to_bytes())
    assert (back.slots(words) == h.slots(words)).all()
    assert (h.slots(rng.integers(0, 2**63, (100, 4), dtype=np.uint64)) < 5000).all()


def test_history_and_newcomers(spark):
    old = exact_dedup.digests(docs(spark, [(5, "a", "s"), (9, "b", "s"), (6, "a", "s")]))
    new = exact_dedup.digests(docs(spark, [(1, "b", "s"), (20, "a", "s"), (30, "c", "s"), (31, "c", "s")]))
    old = old.union(exact_dedup.digests(docs(spark, [(2, "only old", "s")])))
    got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(new, old).collect()}
    assert got == {(1, 2), (5, 3), (30, 2), (2, 1)}


# SimHash


def print_of(text, wide=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + wide]) for i in range(max(1, len(words) - wide + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    root = {p: p for p in prints}
    while True:
        again = {p: min(root[q] for q in prints if (p ^ q).bit_count() <= 4) for p in prints}
        if again == root:
            return root
        root = again


def test_simhash(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = list(rng.choice(words, 400))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(400))] = "new"
            rows.append((n * 7 % 1009, " ".join(copy), "s"))
            n += 1
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "Ab É", "s"), (2003, "aB É", "s"), (2003, "aB É", "s"), (None, "ab É", "s")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = {t: print_of(t) for _, t, _ in rows}
    root = components_of(set(prints.values()))
    least = defaultdict(lambda: None)
    for i, t, _ in rows:
        r = root[prints[t]]
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == Counter((i, signed(prints[t]), least[root[prints[t]]]) for i, t, _ in rows)
    assert len(set(least.values())) < len(rows) - 20
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    left = [r["doc_id"] for r in simhash.stage(spark, docs(spark, rows), "").collect()]
    group = alike_groups({t for _, t, _ in rows})
    first = {g: min((i for i, t, _ in rows if group[t] == g and i is not None), default=None) for g in group.values()}
    assert Counter(left) == Counter(first.values()) and 25 < len(left) < n


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def alike_groups(texts):
    """The least text that links of texts with sets of shingles 0.8 alike lead to, for each text."""
    sets = {t: shingles(t) for t in texts}
    near = {t: [u for u in texts if jaccard(sets[t], sets[u]) >= 0.8] for t in texts}
    root = {t: t for t in texts}
    while (again := {t: min((root[u] for u in near[t]), key=lambda t: (t is None, t or "")) for t in texts}) != root:
        root = again
    return root


def test_near_copies_are_exactly_alike(spark):
    """Copies of one text that differ more from each other than from it, texts just below the bound, and a large group of copies."""
    rng = np.random.default_rng(9)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    changed = lambda words, n: " ".join("x%d" % rng.integers(1 << 40) if i in set(rng.choice(len(words), n, replace=False).tolist()) else w for i, w in enumerate(words))
    texts = []
    for n in (2, 3, 5, 8, 14, 20):  # changed words of 300: similarities of 0.93 to 0.5
        base = draw(300)
        texts += [" ".join(base), *(changed(base, n) for _ in range(5))]
    base = draw(200)
    texts += [" ".join(base), *(changed(base, 2) for _ in range(300))]
    texts += [None, "", "one", "ONE", "one two three four", "One two three four", " ".join(base) + " " + " ".join(draw(2000))]
    got = {r["doc_id"]: r for r in simhash.near_copies(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    group, sets = alike_groups(set(texts)), [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(got[i]["root"] == got[j]["root"] for i, j in pairs) >= 0.98 * len(pairs)
    for i, j in [(i, j) for i in range(len(texts)) for j in range(i)]:
        assert group[texts[i]] == group[texts[j]] or got[i]["root"] != got[j]["root"]


def test_trie_forest_links_all_that_brute_force_links():
    rng = np.random.default_rng(1)
    keys = set()
    for b in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(20):
            x = int(b)
            for k in rng.integers(0, 64, int(rng.integers(0, 7))):
                x ^= 1 << int(k)
            keys.add(x)
    keys = np.array(sorted(keys), dtype=np.uint64)
    root = components_of([int(k) for k in keys])
    leaf, top = simhash.trie_forest(keys, 0)
    mine = {int(k): int(k) for k in keys} | {int(keys[a]): int(keys[b]) for a, b in zip(leaf, top)}
    assert mine == root and len(simhash.trie_forest(keys[:0], 0)[0]) == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# Mixing


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["b", "a", "c", None, "tiny"][0 if i % 3 else i % 5]) for i in range(600)] + [(1000, None, "a"), (1001, "x " * 5, "a"), (1001, "x " * 5, "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    aim, total, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = (total - sum(2 * size[s] for s in size if s not in open_)) / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not over:
            break
        open_ -= over
    aim = {s: level * weight[s] if s in open_ else 2.0 * size[s] for s in size}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(aim[r["source"]], abs=1e-3)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - aim[s]) <= mixing.LEAST_PACKET for s in size) and sum(taken.values()) == int(total)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0 and mixing.mix(docs(spark, [(1, None, None)])).first()["taken"] == 0


def queue_of(rows, target):
    """Words taken of rows (doc_id, text, source), by a plain queue ordered by finish time; and by a quota for each source."""
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in target}
    srcs = sorted(target, key=lambda s: (s is None, s or ""))
    entries, quota = [], Counter()
    for s in srcs:
        mine = [(int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16), i, len((t or "").split())) for i, t, x in rows if x == s]
        at = 0
        for turn in range(2):
            for _, i, n in sorted(mine):
                width = max(mixing.LEAST_PACKET, -int(-target[s] // mixing.PACKETS))
                quota[i] += min(n, max(0, round(target[s]) - at))
                for first in range(0, n, width):
                    k = min(width, n - first)
                    entries.append(((at + first + k) / target[s], srcs.index(s), at + first + k, i, k))
                at += n
    left, taken = int(1.5 * sum(size.values())), Counter()
    for _, _, _, i, k in sorted(entries):
        taken[i] += min(k, max(0, left))
        left -= k
    return taken, quota


def test_the_queues_order_decides(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 700))), "abc"[int(rng.integers(3))]) for i in range(300)] + [(400, "w " * 30_000, "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    taken, quota = queue_of(rows, {r["source"]: r["target"] for r in got})
    assert {r["doc_id"]: r["taken"] for r in got} == {i: taken[i] for i, _, _ in rows}
    assert any(taken[i] != quota[i] for i, _, _ in rows)  # a quota without the order gives another mix


def test_repeated_rows_keep_their_words(spark):
    rows = [(1, "a b c d", "x")] * 30 + [(2, "q r s", "y"), (None, None, None)]
    out = mixing.stage(spark, docs(spark, rows), "").collect()
    assert sum(len(r["text"].split()) for r in out) == int(1.5 * 123)


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, f"  one two\n three{i} four ", "ab"[i % 2]) for i in range(40)]
    table = docs(spark, rows)
    out = mixing.stage(spark, table, "")
    assert out.columns == table.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert rows[r["doc_id"]][1].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(table).collect() if r["taken"]})


# Token counts


def test_rollup_commits_once(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    counts = token_counts.counted(docs(spark, [(1, "a b, c", "s"), (2, None, None), (3, "d", "s"), (3, "d", "s")]), "words/1", "pieces/1")
    assert rollup.commit("one", token_counts.inserted(counts, "words/1").union(token_counts.inserted(counts, "pieces/1")))
    assert not rollup.commit("one", token_counts.inserted(counts, "words/1"))
    assert rollup.commit("two", token_counts.deleted(counts.where("doc_id = 3"), "words/1"))
    assert rollup.commit("three", token_counts.revised(counts.where("doc_id = 1"), "words/1", F.col("`words/1`"), F.lit(10)))
    assert rollup.commit("none", token_counts.inserted(counts.limit(0), "words/1"))
    (tmp_path / "r/batch=broken").mkdir()
    got = {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == {("s", "words/1"): (1, 10), (None, "words/1"): (1, 0), ("s", "pieces/1"): (3, 6), (None, "pieces/1"): (1, 0)}
    shown = lambda: {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    for k in range(2):
        assert rollup.compact() and shown() == got
        assert not rollup.commit("one", token_counts.inserted(counts, "words/1")) and shown() == got
        rollup.vacuum()
        assert not rollup.commit("one", token_counts.inserted(counts, "words/1")) and shown() == got and rollup.has("none")
        assert rollup.commit(f"after{k}", token_counts.inserted(counts.where("doc_id = 3").limit(1), "words/1"))
        got["s", "words/1"] = got["s", "words/1"][0] + 1, got["s", "words/1"][1] + 1
        assert shown() == got
    assert rollup.commit("broken", token_counts.inserted(counts.limit(0), "words/1")) and shown() == got
    aside = f"{rollup.path}/_aside-x"
    counts.write.parquet(aside)
    assert not rollup._move(aside, rollup._folder("after1")) and shown() == got  # a second writer comes too late
    assert not list(tmp_path.glob("r/_aside*"))
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)


def test_counts_of_a_vocabulary(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_counts.bpe.default_tokenizer())
    rows = [(1, "Hello wörld, it's 日本", "s"), (2, None, "s"), (3, "word " * 60_000, "t"), (3, "", None), (None, "a-b", "t")]
    got = token_counts.counted(docs(spark, rows), "words/1", "word_bpe_49k/1")
    assert got.columns == ["doc_id", "source", "lang", "words/1", "word_bpe_49k/1"]
    want = Counter((i, s, len((t or "").split()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, s in rows)
    assert Counter((r[0], r[1], r[3], r[4]) for r in got.collect()) == want
    assert token_counts.counted(docs(spark, []), "word_bpe_49k/1").count() == 0


# Tool calls

ADD = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "l": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}
CALLS = "thread string, call_id string, needs array<string>, name string, arguments string, level int"


def linked(spark, calls, results):
    """What link() gives, with a clashing column."""
    return tool_calls.link(spark.createDataFrame([(*c, 7) for c in calls], CALLS), spark.createDataFrame(results, "call_id string, content string"), {"add": ADD}).collect()


def levels_by_hand(calls):
    needs = defaultdict(set)
    for _, i, n, *_ in calls:
        if i is not None:
            needs[i] |= set(n or [])
    needs = {i: {x for x in n if x in needs} for i, n in needs.items()}
    level = {}
    while ready := {i: max((level[x] + 1 for x in n), default=0) for i, n in needs.items() if i not in level and all(x in level for x in n)}:
        level |= ready
    return {i: level.get(i) for i in needs}


def test_tool_calls_against_brute_force(spark):
    calls = [
        ("t", "c1", None, "add", '{"a": 1}'), ("t", "c2", ["c1"], "add", '{"l": ["é\\u001f"], "a": 2}'), ("t", "c3", ["c2", "c1", "gone", None], "add", '{"a": -1}'), ("t", "x1", ["x2"], "add", '{"a": 1}'), ("t", "x2", ["x1"], "add", '{"a": true}'),
        ("t", "x3", ["c1", "x2"], "add", '{"a": 1.0}'), ("t", "me", ["me"], "add", '{"a": 1}'), ("t", "n1", ["gone"], "nope", "{}"), ("t", None, None, "add", None), (None, None, ["c1"], None, None), ("u", "d", ["c3"], "add", '{"a": 1, "b": 2}'),
        ("u", "d", ["e"], "add", "{"), ("u", "e", [], "add", '{"a": NaN}'), ("u", "e2", ["d"], "add", '{"a": 1e999}'), ("u", "s", None, "add", '{"a": 1, "l": ["\\ud800"]}'), ("v", "long", None, "add", json.dumps({"a": 3, "l": ["x" * 200_000]})), ("v", "long", None, "add", json.dumps({"a": 3, "l": ["x" * 200_000]})),
    ]
    results = [("c1", 'r "1"\n\x1f'), ("c2", None), ("d", "p"), ("d", "q"), ("d", "r"), ("zz", "lost"), (None, "none"), ("long", "y" * 200_000), ("long", "y" * 200_000)]
    got = linked(spark, calls, results)
    level = levels_by_hand(calls)
    assert level == {"c1": 0, "c2": 1, "c3": 2, "x1": None, "x2": None, "x3": None, "me": None, "n1": 0, "d": 3, "e": 0, "e2": 4, "s": 0, "long": 0}
    want = Counter()
    for i in {c[1] for c in calls} | {r[0] for r in results}:
        mine, theirs = [c for c in calls if c[1] == i], [r[1] for r in results if r[0] == i]
        pairs = min(len(mine), len(theirs)) if i is not None else 0
        for k in range(max(len(mine), len(theirs)) if i is not None else 0):
            want[i, "linked" if k < pairs else "no_result" if len(mine) > pairs else "no_call"] += 1
        if i is None:
            want[i, "no_result"], want[i, "no_call"] = len(mine), len(theirs)
    assert Counter((r["call_id"], r["status"]) for r in got) == want
    faults = Counter((c[1], tool_calls.checked(c[3], c[4], {"add": ADD})[0]) for c in calls)
    assert Counter((r["call_id"], r["fault"]) for r in got if r["status"] != "no_call") == faults
    assert {f for i, f in faults if i in ("e", "e2", "s")} == {"not JSON"} and ("x3", None) in faults and ("d", "$.b: unknown") in faults
    for r in got:
        assert r["level"] == (level.get(r["call_id"]) if r["status"] != "no_call" else None)
        held = json.loads(r["record"])
        assert r["record"] == tool_calls.canonical(held) and (held["id"], held["name"]) == (r["call_id"], r["name"])
        if r["status"] != "linked":
            assert held["result"] is None or r["status"] == "no_call"
    records = {r["call_id"]: json.loads(r["record"]) for r in got}
    assert records["c1"] == {"arguments": {"a": 1}, "id": "c1", "name": "add", "result": 'r "1"\n\x1f'} and records["c2"]["arguments"] == {"a": 2, "l": ["é\x1f"]}
    places = defaultdict(list)
    for r in got:
        places[r["thread"], r["level"]].append(r["place"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert linked(spark, [], []) == [] and [r["status"] for r in linked(spark, [], [("a", "b")])] == ["no_call"]


def test_levels_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    calls = [("t", f"k{i}", [f"k{i - 1}"] if i else None, "add", "{}") for i in range(40)]
    calls += [("t", f"n{i}", [f"n{j}" for j in rng.integers(0, 60, int(rng.integers(0, 4))) if j < i or rng.random() < 0.03] + ["k39"] * (i % 9 == 0), "add", "{}") for i in range(60)]
    calls += [("t", f"h{i}", ["k0"], "add", "{}") for i in range(300)]
    got = {r["call_id"]: r["level"] for r in tool_calls.levels(spark.createDataFrame([(*c, 0) for c in calls], CALLS)).collect()}
    assert got == levels_by_hand(calls) and None in got.values() and max(x for x in got.values() if x is not None) > 41


@pytest.mark.parametrize(
    ("value", "schema", "found"),
    [
        ("x", {"type": ["string", "null"]}, None), (None, {"type": ["string", "null"]}, None), (1, {"type": ["string", "null"]}, "$: not string or null"), (1.0, {"type": "integer"}, None), (1.5, {"type": "integer"}, "$: not integer"),
        (True, {"enum": [1]}, "$: not in enum"), (1, {"const": 1.0}, None), ("ab", {"minLength": 3}, "$: too short"), ("ab", {"pattern": "^b"}, "$: no match"), ([1, 1], {"uniqueItems": True}, "$: not unique"), ([], {"minItems": 1}, "$: too few"),
        (6, {"multipleOf": 4}, "$: no multiple"), (3, {"exclusiveMinimum": 3}, "$: not above minimum"), ({"a": 1, "b": "x"}, {"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}, "$.b: not integer"),
        (1, {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "$: fits none"), (1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}, "$: fits 2 of one"), (1, {"not": {"type": "integer"}}, "$: fits what it must not"), (1, {"allOf": [{"minimum": 0}, {"maximum": 0}]}, "$: above maximum"),
    ],
)
def test_schema_keywords(value, schema, found):
    tool_calls.check_schema(schema)
    assert tool_calls.fault(value, schema) == found


def test_schemas_that_are_not_supported_are_refused(spark):
    with pytest.raises(ValueError, match="dependentSchemas"):
        tool_calls.checker({"t": {"properties": {"x": {"dependentSchemas": {}}}}})


def test_calls_of_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): r for r in turns.collect()}
    got = tool_calls.query(spark, sf_dir).where("status <> 'no_call'").collect()
    assert len(got) == sum(r["role"] != "assistant" for r in rows.values())
    for r in got:
        c, t = map(int, r["call_id"].split(":"))
        answer = rows.get((c, t + 1))
        assert r["status"] == ("linked" if answer and answer["role"] == "assistant" else "no_result")
        level, k = 0, t - 2
        while (c, k) in rows and rows[c, k]["role"] != "assistant":
            level, k = level + 1, k - 2
        assert r["level"] == level


def test_numbers_of_a_hot_key(spark):
    rows = spark.range(0, 3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = defaultdict(list)
    for r in numbered(rows, ["k"], ["id"], "n").collect():
        got[r["k"]].append(r["n"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values()) and len(got["hot"]) == 2000


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.written(stage(spark, table, sf_dir), "test")
        assert after.columns == table.columns
        counts.append(after.count())
        if name == "exact_dedup":
            assert after.select("text").distinct().count() == counts[-1]
        table = after
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_counts.bpe.default_tokenizer())
    rng = np.random.default_rng(21)
    words = [f"w{i}ö" for i in range(400)]
    draw = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, draw(int(rng.integers(60, 400))), "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n ", 3), "a") for i in range(10)] + [(200 + i, rows[i][1] + " tail", None) for i in range(5)]
    rows += [(300, None, "a"), (301, "", None), (302, "same words here " * 60, "b"), (303, "few words", "b"), (304, draw(9000), "c"), (305, draw(120), None), rows[3], rows[3], (5, draw(80), "a"), (None, draw(90), "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # of one kind: no rule is learned
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    def passes(text):
        w = (text or "").split()
        seen = Counter(zip(w, w[1:], w[2:]))
        repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    order = lambda r: (r[0] is None, r[0] or 0)
    groups = defaultdict(list)
    for r in filter(lambda r: passes(r[1]), rows):
        groups[re.sub("[\x20\x09-\x0d]+", " ", r[1])].append(r)
    left = [min(g, key=order) for g in groups.values()]
    root = alike_groups({r[1] for r in left})
    near = defaultdict(list)
    for r in left:
        near[root[r[1]]].append(r)
    left = [min(g, key=order) for g in near.values()]
    ids = [r[0] for r in left]
    assert len(set(ids)) == len(ids) - 1 and len(left) < len(rows) - 15  # two texts share the id 5, and both stay
    mixed = mixing.mix(docs(spark, left)).collect()
    target = {r["source"]: r["target"] for r in mixed}
    assert sum(r["taken"] for r in mixed) == int(1.5 * sum(len(t.split()) for _, t, _ in left)) and len(target) > 3
    due = defaultdict(list)
    for r in mixed:
        due[r["doc_id"], r["size"]].append(r["taken"])
    want = Counter()
    for i, t, _ in left:
        spaced, n = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", t), due[i, len(t.split())].pop()
        for part in (min(n, len(spaced)), n - len(spaced)):
            if part > 0:
                found = library.encode(t if part == len(spaced) else "".join(spaced[:part]), add_special_tokens=False)
                text = library.decode(found.ids, skip_special_tokens=False)
                want[i, len(found.ids), hashlib.sha256(" ".join(map(str, found.ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_stages_keep_columns_of_any_name(spark):
    """Columns that have the names of the stages' own helpers come through with their values."""
    names = ["__row", "__row_key", "__size", "__taken", "__due", "__part", "__ROW_KEY_", "one", "key", "fp", "band", "row", "size", "digest", "x.y"]
    rows = [(i, f"text {i} of some words {i} " * 9, "s", 3, *[100 * i + k for k in range(len(names))]) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    want = {r[0]: r[4:] for r in rows}
    for stage in (exact_dedup.stage, simhash.stage, mixing.stage):
        out = stage(spark, table, "")
        assert out.columns == table.columns
        left = out.collect()
        assert {r[0] for r in left} <= set(want) and len(left) >= 6 and all(tuple(r)[4:] == want[r[0]] for r in left)


def test_a_batch_that_lands_in_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    change = spark.createDataFrame([("s", "en", "words/1", 1, 10)], token_counts.CHANGE_SCHEMA)
    assert rollup.commit("a", change)
    add = rollup._sum

    def late(batches, k):
        assert rollup.commit("b", change)
        return add(batches, k)

    monkeypatch.setattr(rollup, "_sum", late)
    assert rollup.compact()
    monkeypatch.undo()
    for again in range(2):
        assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(2, 20)] and rollup.has("a") and rollup.has("b") and not rollup.commit("b", change)
        rollup.vacuum()
        assert again or rollup.compact()


BROKEN = [{"type": "text"}, {"type": ["string", 1]}, {"multipleOf": 0}, {"multipleOf": "2"}, {"pattern": "("}, {"pattern": 3}, {"items": [True]}, {"enum": "abc"}, {"required": "a"}, {"minLength": -1}, {"anyOf": []}, {"anyOf": {}}, {"properties": {"a": 1}}, {"uniqueItems": 1}, {"maximum": True}, [], {"not": {"type": "x"}}]


@pytest.mark.parametrize("schema", BROKEN, ids=str)
def test_broken_schemas_are_refused_before_the_job(schema):
    with pytest.raises(ValueError, match=r"^\$"):
        tool_calls.check_schema({"properties": {"a": schema}} if isinstance(schema, dict) else schema)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_of_a_band_are_linked_without_its_first_last_and_most(spark):
    words = lambda k, n: set(range(k * 1000, k * 1000 + n))
    # Two that are alike among others that are not; and in another band texts that are each like the next only, a chain.
    band = [words(1, 100), words(5, 100), words(5, 90), *(words(k, 100) for k in range(10, 10 + 2 * simhash.SLICE)), words(2, 100)]
    chain = [set(range(10**6 + 12 * k, 10**6 + 12 * k + 200)) for k in range(40)]
    rows = [(k.to_bytes(4, "big"), np.array(sorted(x), np.uint64).tobytes(), (1 + k) << 40 | (k * 0x9E3779B9 & 0xFFFFFFFF), [7 if k < len(band) else 8]) for k, x in enumerate(band + chain)]
    table = written(spark.createDataFrame(rows, "key binary, shingles binary, fp long, bands array<long>"), "test")
    found = simhash.linked(table.select("key", "fp", "bands"), lambda keys: table.select("key", "shingles").join(keys, "key", "left_semi"))
    groups = [set(r["keys"]) for r in found.groupBy("root").agg(F.collect_set("key").alias("keys")).collect()]
    keys = [r[0] for r in rows]
    assert sorted(len(g) for g in groups if len(g) > 1) == [2, len(chain)] and set(keys[1:3]) in groups and set(keys[len(band) :]) in groups
    assert sum(map(len, groups)) == len(rows)

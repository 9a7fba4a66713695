import re

import numpy as np
import pytest

from helixframe.llm import ann, bpe, chat, decontaminate, near_dedup, substring_dedup, token_counts
from helixframe.llm.queries import vocabulary

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(200)]
ODD = [(90, None), (91, ""), (92, "one two"), (93, "one two"), (94, "x" * 50_000), (95, " \n\t")]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tokenizer_agrees_with_library():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["", "It's 'red <|endoftext|>x", "ÉÀ ß Σίσυφος 漢字 🙂 12.5 'll''s", "a" * 3000, "\t\n", "don't we'ver 'v'e"]
    mine, counter = bpe.WordBpe(vocabulary("word_bpe_49k.json")), token_counts.Counter(vocabulary("word_bpe_49k.json"))
    for t, n in zip(texts, counter.count(texts), strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
        assert n == len(ids)


def test_chat_reads_back():
    for role, text in [("user", "\\### Assistant: </turn> ok"), ("a:b", "<image:0> \\"), (None, None), ("assistant", "### x\n")]:
        formatted, a, b, _ = chat.format_turn(role, [{"type": "text", "text": text}])
        assert chat.read_back(formatted * 2) == [(role or "", text or "")] * 2
        assert chat.unescape(formatted[a:b]) == ((text or "") if role == "assistant" else "")
    formatted, _, _, attached = chat.format_turn("user", [{"type": "image", "ref": "r", "tiles": 2}, {"type": "text", "text": "hi"}])
    assert "<image:0>hi" in formatted and attached == [("image", "r", 1152)]


def test_near_duplicates(spark):
    base = WORDS[:100]
    near = [*base[:50], "other", *base[51:]]
    data = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(base)), (4, " ".join(WORDS[100:])), *ODD]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(data, DOCS), k=3, percent=85).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert got[90].n_shingles == got[91].n_shingles == 0 and got[91].kept and got[93].component_id == 92
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_contamination(spark):
    items = [(1, " ".join(WORDS[:12])), (2, "solo word"), (3, None), (4, "")]
    data = [(1, "zz " + "; ".join(WORDS[:12]).upper() + " zz"), (2, "a solo, word"), (3, " ".join(WORDS[1:10])), *ODD]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(data, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (14, 12, 1)
    assert got[2].n_hit == 2 and not got[3].contaminated and got[90].n_words == 0


def test_passages(spark):
    passage = WORDS[:70]
    fuzzy = [*passage[:30], "changed", *passage[31:]]
    data = [(1, " ".join(["a1", "a2", *passage, "a3"])), (2, " ".join([*[f"b{i}" for i in range(40)], *fuzzy])), (3, " ".join(WORDS[100:])), *ODD]
    docs = spark.createDataFrame(data, DOCS)
    assert rows(substring_dedup.passages(docs), "doc", "other_doc", "start_word", "end_word") == [(2, 1, 40, 110)]
    cut = dict(rows(substring_dedup.without_repeats(docs).where("doc_id < 90"), "doc_id", "text"))
    assert re.findall(r"w\d+", cut[2]) == [] and len(cut) == 3


def test_nearest_by_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(400, 16))
    x[7] = x[3]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    for q in (0, 100, 200, 300):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert hit >= 18


def linked_by_brute_force(texts, k, percent):
    """Smallest row number reachable, over all pairs."""
    sets = [set(near_dedup.set_hashes(t, k).tolist()) for t in texts]
    want = list(range(len(texts)))

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                want[y] = x
    return [root(x) for x in range(len(texts))]


@pytest.mark.parametrize(("n", "k", "percent"), [(120, 3, 85), (700, 3, 85), (300, 5, 80)])
def test_large_groups_lose_no_link(spark, n, k, percent):
    """Near copies of a few bases, many of them not linked with the middle of their group."""
    rng = np.random.default_rng(n)
    bases = [[WORDS[i] for i in rng.integers(0, 200, 80)] for _ in range(3)]
    data = []
    for i in range(n):
        w = list(bases[0 if i % 4 else i // 4 % 3])
        for j in rng.integers(0, 80, rng.integers(0, 9)):
            w[j] = WORDS[rng.integers(0, 6)]
        data.append((i, " ".join(w[: rng.integers(60, 81)] if i % 3 == 0 else w)))
    want = linked_by_brute_force([t for _, t in data], k, percent)
    assert len(set(want)) < n
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(data, DOCS), k=k, percent=percent), "doc_id", "component_id") == list(enumerate(want))


def test_chains_by_brute_force():
    """The best predecessor within reach, also after a long chain whose end lies out of reach."""
    cost, gain, gap = substring_dedup.GAP_COST, substring_dedup.GAIN, substring_dedup.MAX_GAP
    first = np.arange(0, 300, 5)
    two = [np.concatenate([first, first + 360]), np.concatenate([first, first + 360])]
    got = substring_dedup.chains(*two)
    assert sorted((int(two[0][c[0]]), int(two[0][c[-1]])) for c in got) == [(0, 295), (360, 655)]
    rng = np.random.default_rng(5)
    for _ in range(20):
        anchors = sorted({(int(x), int(y)) for x, y in zip(rng.integers(0, 200, 150), rng.integers(0, 200, 150), strict=True)} | {(x, x + 7) for x in range(0, 60, 3)})
        best: list[float] = []
        for i, (x, y) in enumerate(anchors):
            steps = [best[j] - cost * (x - u + y - v) for j, (u, v) in enumerate(anchors[:i]) if 0 < x - u <= gap and 0 < y - v <= gap]
            best.append(gain + max([0.0, *steps]))
        top = substring_dedup.chains(*(np.array(a) for a in zip(*anchors, strict=True)))[0]
        steps = [anchors[j] for j in top]
        assert abs(gain * len(steps) - cost * (sum(steps[-1]) - sum(steps[0])) - max(best)) < 1e-6


def covered_words(df):
    return {(r.doc, w) for r in df.collect() for w in range(r.start_word, r.end_word)}


def test_passages_whose_seeds_occur_earlier(spark):
    """Every seed of the passage first occurs in a small document, and the first holder of its rarer seeds is not its holder."""
    passage = [f"p{i}" for i in range(60)]
    data = [(i, " ".join([f"s{i}", *passage[i : i + 7], f"t{i}"])) for i in range(54)]
    data += [(100, " ".join([*WORDS[:30], *passage, *WORDS[30:60]])), (101, " ".join([*WORDS[60:90], *passage, *WORDS[90:120]]))]
    data += [(102, " ".join([*WORDS[120:140], *passage[:30], *WORDS[140:199], *passage[30:]])), (103, " ".join([*passage[:25], "new", *passage[26:]]))]
    got = covered_words(substring_dedup.passages(spark.createDataFrame(data, DOCS)))
    assert {w for d, w in got if d == 101} == set(range(30, 90))
    assert {w for d, w in got if d == 103} == set(range(60))
    assert {d for d, _ in got} == {101, 103}


def test_fuzzy_passages(spark):
    """Passages of 100 words with a change every 6th to 10th word, 40 of each: all that have a common run of 5 words are found."""
    rng = np.random.default_rng(7)
    data, n = [], 0
    for every in (6, 7, 8, 10):
        for _ in range(40):
            words = [f"x{v}" for v in rng.integers(0, 1 << 40, 160)]
            fuzzy = [f"y{v}" if i % every == every - 1 else w for i, (w, v) in enumerate(zip(words[30:130], rng.integers(0, 1 << 40, 100), strict=True))]
            data += [(n, " ".join(words)), (n + 1, " ".join(fuzzy))]
            n += 2
    got = substring_dedup.passages(spark.createDataFrame(data, DOCS)).collect()
    assert sorted((r.doc, r.other_doc) for r in got) == [(i + 1, i) for i in range(0, n, 2)]
    assert all(r.end_word - r.start_word >= 90 for r in got)


def test_near_duplicates_with_few_shared_sketch_values(spark):
    """A pair over the limit whose union sketches share fewer than 20 of 32 values."""
    rng = np.random.default_rng(11)
    while True:
        words = [f"q{v}" for v in rng.integers(0, 1 << 30, 600)]
        other = list(words)
        for j in range(16):
            other[10 + 36 * j] = f"r{rng.integers(0, 1 << 30)}"
        a, b = (near_dedup.set_hashes(" ".join(w), 3) for w in (words, other))
        union = np.union1d(a, b)[:32]
        shared = len(np.intersect1d(union, np.intersect1d(a, b)))
        if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) and 16 <= shared < 20:
            break
    data = [(1, " ".join(words)), (2, " ".join(other))]
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(data, DOCS), k=3, percent=85), "doc_id", "component_id") == [(1, 1), (2, 1)]


def test_chains_of_many_anchors_by_brute_force(monkeypatch):
    """Looking predecessors up by position and weighing all of them give chains of the same worth."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        found = np.unique(np.stack([rng.integers(0, 90, 1500), rng.integers(0, 120, 1500)], 1), axis=0)
        p, c = found[:, 0], found[:, 1]
        got = []
        for cells in (0, 1 << 30):
            monkeypatch.setattr(substring_dedup, "FEW_CELLS", cells)
            x = substring_dedup.chains(p, c)[0]
            got.append(substring_dedup.GAIN * len(x) - substring_dedup.GAP_COST * (p[x[-1]] + c[x[-1]] - p[x[0]] - c[x[0]]))
        assert abs(got[0] - got[1]) < 1e-6 and got[0] > 5 * substring_dedup.GAIN


def test_blocks_come_back():
    """A seed's block holds all of it; hashes of another bucket stay others."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    doc, pos = np.sort(rng.integers(-(1 << 62), 1 << 62, 5000)), rng.integers(0, 1 << 30, 5000).astype(np.int32)
    b = substring_dedup.blocks(substring_dedup.bucket_of(h, 7), [h, doc, pos], 7, substring_dedup._SEED_STEPS)
    got = substring_dedup.unpacked(b, substring_dedup._SEED, substring_dedup._SEED_STEPS)
    assert sorted(zip(got[1].tolist(), got[2].tolist(), strict=True)) == sorted(zip(doc.tolist(), pos.tolist(), strict=True))
    assert len(np.unique(got[0])) == len(np.unique(h))
    assert sum(len(x) for x in b.column("c").to_pylist()) < 0.95 * 20 * len(h)


def test_equal_runs_of_fuzzy_copies(spark):
    """two documents that are equal where both are only similar to an earlier one."""
    words = [f"f{i}" for i in range(100)]
    fuzzy = [*words[:50], "one", *words[51:]]
    data = [(1, " ".join(["a", *words])), (2, " ".join(["b", *fuzzy])), (3, " ".join(["c", "d", *fuzzy, "e"])), (4, " ".join(["x", *["line"] * 300])), (5, " ".join(["y", "z", *["line"] * 300]))]
    got = rows(substring_dedup.passages(spark.createDataFrame(data, DOCS)), "doc", "other_doc", "start_word", "end_word", "other_start", "equal_words")
    assert (2, 1, 1, 101, 1, 99) in got and (3, 1, 2, 102, 1, 99) in got
    assert any(r[:2] == (3, 2) and r[2] <= 3 and r[3] >= 102 for r in got), got
    assert {w for d, _, s, e, _, _ in got if d == 5 for w in range(s, e)} == set(range(2, 302)) and len(got) < 20


def test_pairs_in_rounds(spark, monkeypatch):
    """Pairs grow faster than the input: seeds are sent in parts, texts go in rounds of bounded size. All pairs, each once."""
    sd = substring_dedup
    stored, of = [], sd.written
    monkeypatch.setattr(sd, "written", lambda df, label="t", *a: stored.append(label) or of(df, label, *a))
    monkeypatch.setattr(sd, "SENT_BYTES", 1500)
    monkeypatch.setattr(sd, "ROW_DOCS", 2)
    seeds = [(h, d, np.int32(h).tobytes()) for d in range(9) for h in range(60)]
    held = spark.createDataFrame(seeds, "h long, cdoc long, cpos binary").coalesce(2)
    pairs = sd.possible(held.where("cdoc > 3").toDF("h", "doc", "dpos"), held)
    want = [(d, c) for d in range(4, 9) for c in range(d)]
    assert rows(pairs, "doc", "cdoc") == want and stored.count("pairs") > 2
    monkeypatch.setattr(sd, "ROUND_LETTERS", 1)
    monkeypatch.setattr(sd, "ROUND_SHARE", 3.0)
    once = spark.createDataFrame([(d, "x" * 100) for d in range(9)], "doc long, text string").coalesce(2)
    parts = sd.in_rounds(pairs, once, "round", lambda part: part)
    # 30 pairs carry 60 texts of 100 letters, 2,700 of which fit one round
    assert len(parts) == 3 and rows(sd.united(parts[0], parts[1:]), "doc", "cdoc") == want
    assert len({d for x in parts for d in {r["doc"] for r in x.collect()}}) == sum(len({r["doc"] for r in x.collect()}) for x in parts)


def test_telling_seeds_meet_every_possible_pair():
    """Documents of 60 words; one seed is held by all, and pairs that share only such seeds need not meet."""
    sd, r = substring_dedup, np.random.default_rng(3)
    docs = []
    for _ in range(60):
        pool = r.integers(0, 4) * 1000
        h = np.where(r.random(56) < 0.85, pool + np.arange(56), 10_000 + r.integers(0, 5000, 56))
        h[r.integers(0, 50)] = 77
        docs.append(h.astype(np.int64))
    holding = {int(v): sum(int((d == v).any()) for d in docs) for v in np.unique(np.concatenate(docs))}
    told, packs = [], []
    for d in docs:
        each = np.unique(d)
        keep = sd.telling([np.flatnonzero(d == v) for v in each], [holding[int(v)] for v in each])
        told.append({int(v) for v, k in zip(each, keep, strict=True) if k})
        o = np.argsort(d, kind="stable")
        packs.append((d[o], o.astype(np.int32)))
    pairs = [(i, j) for i in range(60) for j in range(i)]
    possible = {(i, j) for i, j in pairs if sd.may_pass(*packs[i], *packs[j])}
    met = {(i, j) for i, j in pairs if told[i] & set(docs[j].tolist())}
    assert possible and possible <= met
    assert len(met) < len({(i, j) for i, j in pairs if set(docs[i].tolist()) & set(docs[j].tolist())})

"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import debruijn_dedup, decontaminate, jaccard, merkle, packing, quality, secret_scan, suffix_dedup, token_counts, toxicity
from folioscope.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, entity string, anchor long, row int, start int, doc string, n int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon".split()
PATTERN = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", None, "x", 1, 2, 3, "d", 4) for i, t in rows], SCHEMA)


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def awkward(seed=1):
    """Null, empty, blank, short, very long and repeated texts, copies, near copies and shared passages."""
    draw = random.Random(seed)
    passage = prose(draw, 70)
    rows = [None, "", " \n\t ", "one", "One two  three", "a b c d e", "é Ω 日本語 '😀' don't we'll '' 's", "x" * 900, "ab " * 400]
    base = [prose(draw, 120) for _ in range(6)]
    rows += base + base[:3]
    for text in base[:4]:
        words = text.split()
        words[60] = "changed"
        rows += [" ".join(words), text.upper() + " tail", " ".join(words[:40]) + "\n" + passage + "\n" + prose(draw, 30)]
    rows += [prose(draw, 10) + " " + passage[:300], passage + passage, prose(draw, 6000)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def lowered(text):
    return re.findall(PATTERN, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def classes(rows, width=5, percent=75):
    sets = {}
    for i, text in rows:
        words = lowered(text)
        parts = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets[i] = set(parts)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == classes(awkward())


def test_near_duplicates_of_a_large_bucket(spark, monkeypatch):
    """Chains and crowds that share shingles, with buckets cut into parts of eight rows."""
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    draw = random.Random(4)
    base = prose(draw, 60).split()
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(60)] = f"new{draw.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(base[: 30 + k])) for k in range(0, 30, 2)]
    rows += [(200 + k, " ".join(base[:12]) + " " + prose(draw, 30)) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_tree_search_finds_all():
    import numpy as np

    draw = np.random.default_rng(2)
    points = draw.poisson(3, (300, jaccard.GROUPS))
    points[150:] = np.maximum(0, points[:150] + draw.integers(-1, 2, (150, jaccard.GROUPS)))
    n = points.sum(1)
    tree = jaccard.CountTree(points, n)
    for i in range(0, 300, 7):
        both = np.minimum(points, points[i]).sum(1)
        fit = (both >= jaccard.needed(n[i], n, 75)) & (100 * np.minimum(n, n[i]) >= 75 * np.maximum(n, n[i]))
        assert tree.search(points[i], n[i], 75).tolist() == np.flatnonzero(fit).tolist()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20), (5, 1), (30, 40), (40, 35)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 30: 30, 35: 30, 40: 30}


def without_bytes(rows, window):
    count = Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        count.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [2048, 3])
def test_suffix_dedup(docs, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 100).collect()}
    assert got == without_bytes(awkward(), 100)


def test_suffixes_are_sorted():
    import numpy as np

    draw = np.random.default_rng(3)
    rows = draw.integers(97, 99, (200, 12), dtype=np.uint8)
    length = draw.integers(0, 13, 200)
    rows[np.arange(12) >= length[:, None]] = 0
    group = draw.integers(0, 4, 200)
    order, lcp = suffix_dedup.neighbours(group, rows, length)
    keys = [(group[i], rows[i, : length[i]].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert all(a == 0 or lcp[a] == -1 or keys[a][1][: lcp[a]] == keys[a - 1][1][: lcp[a]] for a in range(200))


def without_words(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        words = re.findall(PATTERN, t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first.setdefault(tuple(words[s : s + window]), (i, s)) != (i, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_debruijn_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn_dedup.remove_repeats(docs).collect()}
    assert got == without_words(awkward(), 20)


def test_decontamination(spark):
    draw = random.Random(5)
    items = [prose(draw, 40) for _ in range(5)]
    a, b = items[0].split()[:20], items[0].split()[20:]
    rows = [
        (0, "before " + items[0].upper() + " after"), (1, prose(draw, 5) + " " + " ".join(b) + " between " + " ".join(a)),
        (2, " ".join(items[1].split()[:15])), (3, None), (4, ""), (5, prose(draw, 200)), (6, items[2] + " " + items[2]), (7, "tiny item here"),
    ]
    bench = spark.createDataFrame([*enumerate(items), (10, None), (11, ""), (12, "Tiny item")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judge(frame(spark, rows), bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {0, 1, 6, 7}
    assert (got[0].item_id, got[0].coverage, got[1].coverage, got[1].n_tiles) == (0, 1.0, 1.0, 2)
    assert got[2].coverage == 15 / 40 and got[3].item_id is None and got[7].item_id == 12
    docs = frame(spark, rows)
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5}
    tiles = {(r.doc_id, r.item_id): r for r in decontaminate.common_tiles(docs, bench).collect()}
    assert tiles[1, 0].lengths == [20, 20] and tiles[1, 0].item_starts == [20, 0]


def test_tiles_do_not_overlap():
    assert decontaminate.tile([(0, 0, 10), (5, 20, 12)], 3) == [(0, 0, 5), (5, 20, 12)]
    assert decontaminate.tile([(0, 0, 6), (0, 10, 6)], 5) == [(0, 0, 6)]


def test_secret_scan(spark):
    draw = random.Random(6)
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    rows, planted = [], {}
    for i in range(60):
        text = prose(draw, 30)
        if i % 3 == 0:
            planted[i] = key()
            text += f' token = "{planted[i]}" ' + prose(draw, 5)
        elif i % 3 == 1:
            text += f" see commit {key()} or mail user{i}@mail.example.com 2024-01-02T10:11:12.000"
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " "), (103, "token = \"" + planted[0] + "\" and token = \"" + planted[0] + "\""), (104, prose(draw, 20_000))]
    docs = frame(spark, rows)
    forest = secret_scan.train(secret_scan.labelled_findings(docs))
    got = {r.doc_id: [x.secret for x in r.secrets] for r in secret_scan.scan(docs, forest).collect()}
    assert {i: s for i, s in got.items() if s} == {**{i: [k] for i, k in planted.items()}, 103: [planted[0]] * 2}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert clean[103] == 'token = "[secret]" and token = "[secret]"' and clean[100] is None
    assert all(clean[i] == t for i, t in rows if i not in got or not got[i])
    assert secret_scan.redact(docs, forest).columns == docs.columns


def test_secrets_inside_one_word(spark):
    draw = random.Random(16)
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    train = [(i, f'token = "{key()}" ' + prose(draw, 5) + (f" see commit {key()} in config-{i}-service.yaml" if i % 2 else "")) for i in range(60)]
    forest = secret_scan.train(secret_scan.labelled_findings(frame(spark, train)))
    a, b, c, d = key(), key(), key(), key()
    rows = [
        (0, f'{{"file":"config-2024-service.yaml","token":"{a}"}}'), (1, f"token={a},{b}"), (2, f'{{"tokens":["{a}","{b}","{c}"]}}'),
        (3, f"https://www.example.org/a?page=20&token={a}&secret={b} end"), (4, f"commit={a};token={b};digest={c};auth={d}"),
    ]
    docs = frame(spark, rows)
    got = {r.doc_id: [x.secret for x in r.secrets] for r in secret_scan.scan(docs, forest).collect()}
    assert got == {0: [a], 1: [a, b], 2: [a, b, c], 3: [a, b], 4: [b, d]}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert clean[0] == '{"file":"config-2024-service.yaml","token":"[secret]"}'
    assert clean[4] == f"commit={a};token=[secret];digest={c};auth=[secret]"


def test_toxicity(spark):
    draw = random.Random(7)
    insults = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(400):
        words = prose(draw, 40).split()
        if i % 4 == 0:
            words[draw.randrange(40)] = draw.choice(insults)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 4 == 0)))
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 5 <> 0")
    model = toxicity.train(docs, table)
    more = frame(spark, [(1000, None), (1001, ""), (1002, "you i d i o t"), (1003, "what an Idi.ot!"), (1004, prose(draw, 5000)), (1004, "a moron")])
    got = toxicity.score_toxicity(docs.unionByName(more), model).collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400)
    assert right >= 390 and len(got) == 406
    last = sorted((r.doc_id, r.predicted) for r in got if r.doc_id >= 1000)
    assert last == [(1000, 0), (1001, 0), (1002, 1), (1003, 1), (1004, 0), (1004, 1)]
    kept = toxicity.kept(docs.unionByName(more), model)
    assert kept.schema == docs.schema and kept.where("doc_id >= 1000").count() == 3


def test_toxicity_learns_several_vocabularies(spark):
    """Rare insults of four vocabularies, near copies and repeated ids and labels; each is found on texts held out."""
    draw = random.Random(11)
    insults = [[f"{a}{b}" for b in ("ork", "umph", "itzel")] for a in ("sn", "gr", "kw", "pl")]
    rows, labels = [], []
    for i in range(1200):
        words = prose(draw, 40).split()
        if i % 5 == 0:
            words[draw.randrange(40)] = draw.choice(insults[i // 5 % 4])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
        if i % 50 == 0:
            words[draw.randrange(40)] = "altered"
            rows += [(3000 + i * 10 + k, " ".join(words)) for k in range(5)]
            labels += [(3000 + i * 10 + k, int(i % 5 == 0)) for k in range(5)]
    held = {i for i in range(1200) if i // 20 % 4 == 1}
    table = spark.createDataFrame([x for x in labels if x[0] not in held] * 2 + [(9999, 1), (1, None)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (0, "another text under a known id"), (2, None)])
    model = toxicity.train(docs, table)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame(spark, [r for r in rows if r[0] in held]), model).collect()}
    for k in range(4):
        of = [i for i in held if i % 5 == 0 and i // 5 % 4 == k]
        assert sum(got[i] for i in of) >= 0.85 * len(of)
    clean = [i for i in held if i % 5]
    assert sum(got[i] for i in clean) <= 0.05 * len(clean)
    assert (toxicity.train(docs, table).weights == model.weights).all()
    # No text at all, no label, and no room for any text.
    for some, marks, room in ((docs.limit(0), table, 1 << 20), (docs, table.limit(0), 1 << 20), (docs, table, 0)):
        constant = toxicity.train(some, marks, max_bytes=room)
        assert toxicity.score_toxicity(docs, constant).where("predicted = 1").count() == 0


def test_toxicity_without_both_labels():
    assert toxicity.fit([], []).scores is not None
    model = toxicity.fit(["a text", "two texts"], [0, 0])
    assert 0 < model.shift * -1


def test_quality(spark):
    draw = random.Random(8)
    rows = [(i, prose(draw, 60) if i % 3 else " ".join(w + "###" for w in prose(draw, 60).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    more = frame(spark, [(1000, None), (1001, ""), (1002, "x"), (1003, prose(draw, 9000))])
    got = {r.doc_id: r for r in quality.score_quality(docs.unionByName(more), model).collect()}
    assert sum(got[i].predicted == int(i % 3 > 0) for i in range(0, 300, 4)) >= 73
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score


def test_quality_gradient():
    """The gradient against differences of the loss."""
    import numpy as np
    import pyarrow as pa

    from folioscope.llm.shared import text_blocks

    draw = random.Random(9)
    block = next(text_blocks(pa.array([prose(draw, 90), "short", prose(draw, 400), ""])))
    y = np.array([1, 0, 1, 0], np.float32)
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradient(block, y)
    for name, at in (("out", (3,)), ("hidden", (5, 2)), ("filters", (17, 4)), ("filter_bias", (4,)), ("embedding", (101, 3))):
        value, sides = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = value + step
            sides.append(net.gradient(block, y)[1])
        net.p[name][at] = value
        assert abs((sides[0] - sides[1]) / 2e-4 - g[name][at]) < 2e-3


def test_fingerprints(spark):
    rows = awkward()
    got = {r.doc_id: r for r in merkle.against_next(frame(spark, rows).repartition(3)).collect()}
    texts = [t or "" for _, t in rows]
    seen = {}
    for k, text in enumerate(texts):
        following, q = texts[(k + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - q] + following[:q] if q else text
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_edited == 1) == (edited == text) and (r.near_next == 1) == (following == text)
    assert len(set(seen.values())) == len(seen)
    plain = {r.doc_id: r.fingerprint for r in merkle.fingerprints(frame(spark, rows)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_edits_are_located(spark):
    old = "First line here. It has two sentences.\nSecond line stands alone.\n\nThird line. After a gap."
    new = old.replace("alone", "together")
    changed = merkle.edited_leaves(merkle.nodes(frame(spark, [(1, old)])), merkle.nodes(frame(spark, [(1, new)]))).collect()
    assert [new.encode()[r.start : r.end].decode() for r in changed] == ["Second line stands together.\n\n"]


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in awkward()}


def test_token_counts_of_odd_texts(spark):
    draw = random.Random(10)
    parts = ["'", "'s", "'re", "'r", "'ll", " ", "  ", "\n", "\t", "a", "é", "Ω", "1", "½", "!", "<|endoftext|>", "\r\n", "日", "😀", "'S", "́"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(200)))) for i in range(400)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, rows), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 256).collect()
    pieces = {}
    for i, text in awkward():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            some = ids[k : k + 256]
            pieces[i, k // 256] = (k, len(some), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in some)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) <= packing.lower_bound(Counter(r.length for r in got), 256) + 2


def test_bin_completion_is_exact_on_small_cases():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= capacity:
                    place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
            place(k + 1, [*bins, sizes[k]])

        place(0, [])
        return best[0]

    draw = random.Random(11)
    for _ in range(60):
        sizes = sorted((draw.randrange(1, 31) for _ in range(9)), reverse=True)
        patterns = packing.complete_bins(dict(Counter(sizes)), 30)
        assert sum(times for _, times in patterns) == optimum(sizes, 30)
        used = Counter()
        for pattern, times in patterns:
            assert sum(x * k for x, k in pattern.items()) <= 30
            for x, k in pattern.items():
                used[x] += k * times
        assert used == Counter(sizes)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (
        jaccard.near_duplicates(empty), suffix_dedup.remove_repeats(empty), debruijn_dedup.remove_repeats(empty),
        decontaminate.judge(empty, bench), decontaminate.common_tiles(empty, bench), merkle.against_next(empty),
        toxicity.score_toxicity(empty, toxicity.train(empty, labels)), quality.score_quality(empty, quality.train(empty, labels)),
        token_counts.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")), packing.pack(empty, path),
        secret_scan.scan(empty, secret_scan.train(secret_scan.labelled_findings(empty))),
    ):
        assert out.count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    draw = random.Random(12)
    text = prose(draw, 100)
    rows = [(None, text), (None, None), (5, text), (5, text), (6, text), (7, None)]
    docs = frame(spark, rows)
    assert jaccard.near_duplicates(docs).where("doc_id is not null").select("doc_id", "component_id").distinct().count() == 3
    assert {r.n_removed for r in suffix_dedup.remove_repeats(docs, 100).where("n_bytes > 0").collect()} == {len(text)}
    words = [(r.doc_id, r.n_removed) for r in debruijn_dedup.remove_repeats(docs).where("n_words > 0").collect()]
    assert sorted(words, key=str) == sorted([(None, 0), (5, 100), (5, 100), (6, 100)], key=str)
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 6
    assert merkle.against_next(docs).count() == 6


@pytest.mark.parametrize("part", [2048, 1])
def test_texts_without_their_own_id_are_cut_apart(spark, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    draw = random.Random(15)
    passage, own = prose(draw, 60), [prose(draw, 150) for _ in range(8)]
    # Null ids and a repeated id: different texts, one with the passage at another place in each, some without it.
    texts = [own[0] + " " + passage, passage + " " + own[1], own[2], own[3] + " " + passage, passage + " " + own[4], own[5]]
    ids = [None, None, None, 5, 5, 5]
    docs = frame(spark, [*zip(ids, texts, strict=True), (9, passage)])
    expected = without_bytes(list(enumerate([*texts, passage])), 100)
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 100).collect())
    assert got == Counter(expected.values())
    words = {(r.n_words, r.n_removed, bytes(r.kept, "utf8")) for r in debruijn_dedup.remove_repeats(docs).collect()}
    kept = [tuple((len(t.split()), 60, t.replace(passage, "").strip().encode()) for t in texts if passage in t)]
    whole = {(len(t.split()), 0, t.encode()) for t in texts}
    first = {x for x in words if x[1] == 0 and passage.encode() in x[2]}
    # The passage stays in one text without an id, wherever it stands there.
    assert len(first) == 1 and first <= {(210, 0, texts[0].encode()), (210, 0, texts[1].encode())}
    assert words - first == {x for x in kept[0] if x[2] not in {next(iter(first))[2].replace(passage.encode(), b"").strip()}} | {(60, 60, b"")} | {
        x for x in whole if passage.encode() not in x[2]
    }


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*pipeline.COLUMNS)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "", "", 0), (None, "no id", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == pipeline.COLUMNS and 3 <= out.count() <= docs.count()
    assert pipeline.run(spark, sf_dir).where(F.col("length") > 2048).count() == 0


def covered(text, item):
    """Share of an item's words that runs of five words shared with the text cover."""
    have, words = lowered(text), lowered(item)
    seeds = {tuple(have[k : k + 5]) for k in range(len(have) - 4)}
    hit = {k + j for k in range(len(words) - 4) if tuple(words[k : k + 5]) in seeds for j in range(5)}
    return len(hit) / len(words)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    draw = random.Random(17)
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    insults = ["idiot", "moron", "scum"]
    items = [prose(draw, 40) for _ in range(4)]
    texts, labels, keys = {}, [], []
    for i in range(400):
        words = prose(draw, 40).split()
        if i % 4 == 0:
            words[draw.randrange(40)] = draw.choice(insults)
        texts[i] = " ".join(words)
        labels.append((i, 1, int(i % 4 == 0)))
        if i % 4 == 1:
            keys.append(key())
            texts[i] += f' token = "{keys[-1]}" ' + prose(draw, 5)
        elif i % 4 == 2:
            texts[i] += f" see commit {key()} or mail user{i}@mail.example.com 2024-01-02T10:11:12.000"
    near = texts[3].split()
    near[20] = "changed"
    base = prose(draw, 120).split()
    texts |= {500: texts[1], 501: texts[7], 502: " ".join(near), 503: " ".join(base), 504: " ".join([*base[:60], "changed", *base[61:]])}
    texts |= {510: "before " + items[0].upper() + " after", 511: " ".join(items[1].split()[20:] + ["between"] + items[1].split()[:20])}
    texts |= {512: " ".join(items[2].split()[:15]), 513: prose(draw, 60), 514: "", 515: None}
    sf_dir = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = frame(spark, list(texts.items())).select(*pipeline.COLUMNS)
    docs.write.parquet(f"{sf_dir}/documents.parquet")

    def toxic(have):
        return {i: t for i, t in have.items() if not set(insults) & set(lowered(t))}

    def near_duplicates(have):
        root = classes(list(have.items()))
        return {i: t for i, t in have.items() if root[i][1] == i}

    def contaminated(have):
        return {i: t for i, t in have.items() if max(covered(t, item) for item in items) < 0.6}

    def secrets(have):
        return {i: t and re.sub("|".join(keys), "[secret]", t) for i, t in have.items()}

    have, changed = texts, []
    for (_, stage), brute in zip(pipeline.STAGES, (toxic, near_duplicates, contaminated, secrets), strict=False):
        rows = stage(spark, docs, sf_dir).persist()
        expected = brute(have)
        assert sorted((r.doc_id, r.text) for r in rows.collect() if r.text is not None) == sorted((i, t) for i, t in expected.items() if t is not None)
        assert rows.count() == len(expected)
        changed.append(expected != have)
        docs, have = rows, expected
    # Every stage had something to do, and clean documents stay.
    assert all(changed) and {3, 503, 512, 513, 514, 515} <= set(have) and not {0, 500, 501, 502, 504, 510, 511} & set(have)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = Tokenizer.from_file(path)
    expected = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in have.items()}
    pieces = pipeline.run(spark, sf_dir).collect()
    got, filled = Counter(), Counter()
    for r in pieces:
        got[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert got == expected and max(filled.values()) <= 2048

"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import wave
import zlib

import numpy as np
import pytest

pytest.importorskip("platen.llm")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from platen.llm import bpe, components, line_dedup, media, mixing, ngram_join, quality, secrets, suffix_dedup, token_counts, toxicity  # noqa: E402
from platen.llm.shared import shared_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Prose with copies, near copies, shared passages and lines, odd white space, and all the edge rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéüß") for _ in range(r.randint(2, 8))) for _ in range(150)] + ["don't", "I'm", "42", "the", "of"]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    line = "A line that many of the documents share, word for word."
    texts = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        text = " ".join(w + r.choice(["", "", "", ",", ".", "\n"]) for w in words)
        if k % 5 == 0:
            text += " " + passage
        if k % 4 == 0:
            text += "\n" + line + "\n" + line.replace("many", r.choice(["many", "mary", "man", "manyy"]))
        texts.append(text)
    for k in range(0, n, 3):
        copy = texts[k].split(" ")
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], None, None, "", "", " \n\t ", "a", "A", "one two", "ONE TWO", "x" * 5000, "word " * 3000, "tab\tand  two spaces \n\n end ", "<|endoftext|> and <|ENDOFTEXT|>", "😀 emoji été nbsp"]
    return texts


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def shingles(text, n):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def brute_components(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    own = list(range(len(sets)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    return [len(s) for s in sets], [root(x) for x in range(len(sets))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates(docs, texts, n, percent):
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(docs, n, percent).collect()}
    sizes, roots = brute_components(texts, n, percent)
    assert [rows[k].n_shingles for k in range(len(texts))] == sizes
    assert [rows[k].component_id for k in range(len(texts))] == roots


def test_near_duplicates_in_a_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            copy[r.randrange(150)] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts), 4, 85).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_components(texts, 4, 85)[1]


def test_near_duplicates_odd_rows(spark, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = ngram_join.near_duplicates(docs_of(spark, ["same text of six words here", "same text of six words here", "same text of six words here", None], [None, 7, 7, None]), 4, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    own = {}

    def root(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        own[y] = x
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in own if any(x in link and link[0] != link[1] for link in links)}


# 2


def test_secrets(spark, empty):
    r = random.Random(3)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f'words before token = "{hexes(40)}" and after' for _ in range(40)]
    texts += [f"the number {r.randrange(10**15, 10**16)} is a card" for _ in range(40)] + [f"commit {hexes(40)} of the tree" for _ in range(40)]
    texts += [f"password: '{hexes(32)}' noted", f"see {hexes(40)} there", None, "", "no candidates at all"]
    rows = secrets.scan(docs_of(spark, texts)).collect()
    found = {r.doc_id: r for r in rows}
    assert all(found[k].secret for k in range(40)) and found[120].secret
    assert not any(found[k].secret for k in range(40, 120))
    assert all(texts[r.doc_id].encode()[r.start : r.start + r.length].decode() == r.finding for r in rows)
    assert secrets.scan(empty).count() == 0
    assert [r.probability for r in secrets.scan(docs_of(spark, texts[40:42])).collect()] == [0.0, 0.0]
    assert math.isclose(secrets.entropy_of("aabb"), 1.0)


# 3


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def test_quality_features(docs, texts):
    rows = {r.doc_id: r for r in quality.features(docs).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_features(t), k


def test_label_model_finds_the_accurate_rules():
    r = random.Random(5)
    right = [0.95, 0.9, 0.85, 0.8, 0.55]
    patterns, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(4000):
        good = r.random() < 0.8
        votes = tuple(0 if r.random() < 0.2 else (1 if (r.random() < a) == good else -1) for a in right)
        patterns[votes] += 1
        truth[votes].append(good)
    model = quality.fit_label_model(sorted(patterns.items()))
    weight = [o[2] - o[0] for o in model["odds"]]
    assert abs(model["share"] - 0.8) < 0.08 and weight[0] > weight[3] > weight[4]
    decided = sum(abs(sum(v) - (len(v) if model["share"] and math.log(model["share"] / (1 - model["share"])) + sum(o[x + 1] for o, x in zip(model["odds"], k, strict=True)) >= 0 else 0)) for k, v in truth.items())
    assert decided / 4000 < 0.06


def test_judge_quality(spark, docs, empty, sf_dir):
    judged = quality.judge_quality(docs)
    assert judged.count() == docs.count()
    assert judged.where("base_failed and kept").count() == 0 and judged.where("base_failed is null or kept is null").count() == 0
    assert quality.judge_quality(empty).count() == 0
    found = quality.judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "kept")
    labels = {(r.quality, r.kept): r["count"] for r in found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert labels[1, True] > 0.95 * (labels[1, True] + labels.get((1, False), 0))


# 4


def test_token_counts(spark, docs, texts, empty):
    cache = shared_path(spark, "test-cache")
    library = Tokenizer.from_file(WORDS)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, WORDS, cache).collect()}
    assert [rows[k].n_tokens for k in range(len(texts))] == want
    assert [rows[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({rows[k].content_digest for k in range(len(texts))})
    assert token_counts.count_tokens(docs, WORDS, cache).count() == len(texts)
    assert token_counts.read_cache(spark, cache).count() == stored  # all hits: nothing is encoded again
    assert token_counts.count_tokens(empty, WORDS, shared_path(spark, "test-cache")).count() == 0


# 5


def test_mixing(spark, docs, empty):
    targets = {"source": {"src0": 0.5, "src1": 0.3, "src2": 0.1, "": 0.1}}
    cells = mixing.attributes(docs).groupBy(*mixing.MARGINALS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "tokens")
    raked = [r for r in mixing.rake(cells, targets, rounds=30).collect()]
    total = sum(r.weight for r in raked)
    for source, share in targets["source"].items():
        assert abs(sum(r.weight for r in raked if r.source == source) / total - share) < 0.02
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.sampled} == {r.doc_id for r in mixing.sample(docs).collect()}
    assert mixing.mix(empty).count() == 0


def test_the_sample_meets_its_targets(spark):
    texts = [f"write to x{k}@example.org now please" if k % 25 == 0 else f"plain words of text {k} here" for k in range(3000)]
    docs = docs_of(spark, texts)
    drawn = [r.text for r in mixing.sample(docs).collect()]
    before, after = (sum("@" in t for t in x) / len(x) for x in (texts, drawn))
    tempered = lambda x: x**0.7 / (x**0.7 + (1 - x) ** 0.7)
    assert abs(after - tempered(before)) < 0.01 and abs(len(drawn) / len(texts) - 0.9) < 0.03
    assert len(drawn) == sum(r.copies for r in mixing.mix(docs).collect())


# 6


def test_perfect_hash_is_minimal_and_exact():
    ranks = bpe.read_ranks(BPE)
    h = bpe.PerfectHash(ranks)
    assert h.n == len(ranks) and sorted(h.values) == sorted(ranks.values())
    assert all(h.get(k) == v for k, v in list(ranks.items())[::37])
    assert h.get(b"never a token of it") == -1
    assert bpe.PerfectHash({}).get(b"x") == -1


def test_bpe(docs, texts, empty):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}, special_tokens={})
    rows = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()}
    for k, t in enumerate(texts):
        assert rows[k].ids == library.encode_ordinary(t or ""), k
        assert bytes(rows[k].decoded) == (t or "").encode()
    assert bpe.bpe_encode(empty, BPE, public_tokenizers.PATTERN).count() == 0


# 7


def brute_repeats(texts, ids):
    first, out = {}, {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for i, t in zip(ids, texts, strict=True):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = bytes(x for x, g in zip(data, gone, strict=True) if not g), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
    return out


def test_suffix_dedup(spark, docs, texts, empty):
    extra = texts + ["ab" * 400, "ab" * 300, "z" * 2000, "y" + "z" * 60]
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, extra)).collect()}
    for i, (kept, spans) in brute_repeats(extra, range(len(extra))).items():
        assert bytes(rows[i].kept) == kept and len(rows[i].spans) == spans, i
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh") for _ in range(300))
    long = "".join(r.choice("abcdefgh") for _ in range(5000))
    texts = [long[:3000] + shared + long[3000:], shared + "tail", long[100:4000]]
    monkeypatch.setattr(suffix_dedup, "STEP", 512)
    batch = __import__("pyarrow").record_batch({"doc_id": [0, 1, 2], "text": texts})
    found = [tuple(map(tuple, zip(*(x.tolist() for x in p), strict=True))) for p in suffix_dedup._anchored(iter([batch]))]
    strings = {(doc, start + k) for rows in found for _, _, doc, start, count in rows for k in range(count)}
    assert strings == {(d, k) for d, t in enumerate(texts) for k in range(len(t) - 49)}


def test_interval_expansion():
    r = random.Random(9)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(5, 60))).encode() for _ in range(6)]
        got = suffix_dedup.repeated_strings(texts, np.arange(6), 8)
        for i, t in enumerate(texts):
            want = [any(t[k : k + 8] in texts[j] for j in range(i)) for k in range(len(t) - 7)]
            assert got[i].tolist() == want


# 8


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, empty):
    r = random.Random(6)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(15, 40))) for _ in range(25)]
    lines = list(base)
    for line in base:
        for _ in range(4):
            k = r.randrange(len(line))
            lines.append(r.choice([line, line[:k] + "x" + line[k:], line[:k] + line[k + 1 :], line[:k] + "y" + line[k + 1 :], line[:k] + "yy" + line[k + 1 :]]))
    r.shuffle(lines)
    texts = ["\n".join(lines[k : k + 7]) for k in range(0, len(lines), 7)] + [None, "", "short", lines[0]]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    earlier = []
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            gone = len(line) >= line_dedup.MIN_CHARS and any(abs(len(line) - len(e)) < 2 and edit_distance(line, e) <= 1 for e in earlier)
            if not gone:
                kept.append(line)
            if len(line) >= line_dedup.MIN_CHARS:
                earlier.append(line)
        assert rows[i].text == (None if t is None else "\n".join(kept)), i
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, texts)).columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "lines_removed"]


def test_lines_of_a_null_id_and_repeated_rows(spark):
    line = "a line of more than twenty characters"
    rows = line_dedup.dedup_lines(docs_of(spark, [line, line, line, line], [None, 3, 3, 9])).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in rows) == [(-1, line), (3, line), (3, line), (9, "")]


def test_short_lines_that_repeat_go(spark):
    texts = ["Page 1\nfirst\n---", "Page 1\n---\n\nother", "été\nPage 2", "été", None]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts), short=True).collect()}
    assert [rows[k].text for k in range(5)] == [texts[0], "---\n\nother", texts[2], "", None]
    assert [rows[k].lines_removed for k in range(5)] == [0, 1, 0, 1, 0]


# 9


def test_toxicity(spark, empty, sf_dir):
    r = random.Random(7)
    calm = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    texts, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = [r.choice(calm) for _ in range(60)] + ([r.choice(["moron", "scum", "trash", "idiot"]) for _ in range(3)] if toxic else [])
        r.shuffle(words)
        texts.append(" ".join(words))
        labels.append((k, 1, int(toxic)))
    texts += [None, ""]
    docs = docs_of(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, known)
    rows = {x.doc_id: x for x in toxicity.score(docs, index).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((rows[k].score >= 0.7) == bool(labels[k][2]) for k in held) / len(held) > 0.97
    assert 0 <= rows[600].score <= 1 and rows[600].score == rows[601].score
    assert not set(index.ids.tolist()) & set(held)
    # The neighbours against a full comparison.
    vectors = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        for b in range(index.blocks):
            a, z = index.starts[t * index.blocks + b : t * index.blocks + b + 2]
            vectors[index.slots[a:z], t] = index.weights[a:z]
    for k in range(0, 600, 29):
        buf = np.frombuffer(texts[k].encode(), np.uint8)
        slots, weights = index.vector(toxicity.terms_of(buf, np.array([0, len(buf)]))[0])
        cosines = vectors[:, slots] @ weights
        best = sorted(((-round(c, 9), index.ids[i], i) for i, c in enumerate(cosines) if c > 0))[: toxicity.NEIGHBOURS]
        assert index.nearest(slots, weights, toxicity.NEIGHBOURS)[0].tolist() == [i for _, _, i in best]
    assert toxicity.score(empty, index).count() == 0
    nothing = toxicity.fit(docs, known.where("toxic = 0"))
    assert all(x.score < 1e-6 for x in toxicity.score(docs, nothing).collect())


def test_rare_terms_of_a_toxic_text_find_it(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    texts = [" ".join(word() for _ in range(30)) for _ in range(200)]  # no word twice
    copied = next(k for k in range(1, 200, 2) if zlib.crc32(str(k).encode()) % 3 != 1)
    texts.append(" ".join(texts[copied].split(" ")[:28]))
    docs = docs_of(spark, texts)
    index = toxicity.fit(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int"))
    found = {x.doc_id: x for x in toxicity.score(docs, index).collect()}[200]
    assert found.evidence[0].doc_id == copied and found.evidence[0].toxic == 1 and found.evidence[0].cosine > 0.9
    assert len(index.terms) == len({w for k in index.ids.tolist() for w in texts[k].split(" ")})


# 10


def test_media(spark, docs, texts, empty):
    rows = {r.doc_id: r for r in media.media_columns(docs).collect()}
    again = {r.doc_id: r for r in media.fingerprint_wav(media.store_wav(docs)).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        with wave.open(io.BytesIO(bytes(rows[k].media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert (rows[k].n_bytes, rows[k].payload_bytes, rows[k].payload_sha256, rows[k].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert rows[k].fp_time == again[k].fp_time and len(rows[k].fp_time) == len(rows[k].fp_hash)
    assert rows[0].fp_hash == rows[texts.index(texts[0], 1)].fp_hash
    assert media.media_columns(empty).count() == 0
    broken = media.fingerprint_wav(spark.createDataFrame([(1, None), (2, bytearray(b"no wav"))], "doc_id long, media binary")).collect()
    assert [r.payload_bytes for r in broken] == [None, None]


def test_a_tone_peaks_at_its_frequency():
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(8000) / media.RATE)).astype(np.uint8).tobytes()
    _, bins = media.peaks_of(tone)
    assert collections.Counter(bins.tolist()).most_common(1)[0][0] == round(1000 * media.FRAME / media.RATE)


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "some text of a few words", "en", "a", 3, 9, "x", "y")], SCHEMA + ", n long, token string, _copy string")
    assert ngram_join.keep_one(frame).columns == frame.columns
    assert mixing.sample(frame).columns == frame.columns
    assert line_dedup.dedup_lines(frame).columns == [*frame.columns, "lines_removed"]
    assert media.media_columns(frame).count() == 1 and quality.judge_quality(frame).count() == 1

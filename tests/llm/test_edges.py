"""Repeated ids, clashing names, busy keys and other tokenizers, each against a brute-force version."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

pytest.importorskip("platen.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from platen.llm import bpe, line_dedup, media, mixing, ngram_join, quality, secrets, shared, suffix_dedup, token_counts, toxicity  # noqa: E402
from tests.llm.test_operators import BPE, SCHEMA, brute_components, brute_repeats, corpus, docs_of  # noqa: E402


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def changed(base, seed, times):
    r, copy = random.Random(seed), list(base)
    for k in range(times):
        copy[r.randrange(len(copy))] = f"new{seed}x{k}"
    return copy


# 1


def test_texts_of_one_id_keep_their_own_links(spark):
    x, y = words(1, 200), words(2, 200)
    texts, ids = [x, y, changed(x, 3, 1), changed(y, 4, 1)], [5, 5, 6, 7]
    rows = ngram_join.near_duplicates(docs_of(spark, [" ".join(t) for t in texts], ids), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (6, 5), (7, 5)]
    # Judged by row: the second text of 5 is a copy of 3's.
    rows = ngram_join.keep_one(docs_of(spark, [" ".join(t) for t in (x, y, y)], [5, 5, 3])).collect()
    assert sorted((r.doc_id, r.text == " ".join(x)) for r in rows) == [(3, False), (5, True)]


@pytest.mark.parametrize("many", [0, 3])
def test_busy_shingles_lose_no_link(spark, monkeypatch, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    r = random.Random(11)
    head = words(5, 60)
    texts = [changed(head, k, r.choice([1, 2, 3])) + changed(words(6 + k % 5, 100), 100 + k, r.choice([0, 1, 4])) for k in range(50)]
    texts = [" ".join(t) for t in texts]
    rows = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts), 3, 70).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_components(texts, 3, 70)[1]


def test_links_at_the_bound_for_many_sizes(spark):
    """Pairs just above and below the threshold, for sets of 1 to 120 shingles."""
    texts = []
    for size in range(4, 120, 5):
        base = words(size, size, 10**6)
        for cut in range(1, 5):
            texts += [" ".join(base), " ".join(base[: max(1, len(base) - cut * max(1, size // 25))])]
    rows = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(docs_of(spark, texts), 4, 85).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_components(texts, 4, 85)[1]


# 2


def test_candidates_and_coverage():
    text = b'password: \'hunter2!x\' db://bob:p@ss.w0rd@host/db eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJ it.is api_key="zz 99" aVeryLongWordIndeed x==1 token=abc'
    assert [text[a:z] for a, z in secrets.spans_of(text)] == [b"hunter2!x", b"p@ss.w0rd", b"eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJ", b"aVeryLongWordIndeed"]
    r, known = random.Random(2), ["abc", "bca", "cab", "abca", "ccc", "aab"]
    automaton = secrets.Words(known)
    for _ in range(200):
        run = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        inside, longest = set(), 0
        for w in known:
            for k in range(len(run)):
                if run.startswith(w, k):
                    inside |= set(range(k, k + len(w)))
                    longest = max(longest, len(w))
        assert automaton.coverage(run.encode()) == (len(inside) / len(run), longest)
    assert secrets.Words([]).coverage(b"abc") == (0.0, 0)


def test_corpus_counts(spark):
    docs = docs_of(spark, ["the word and the word", "the end", 'key = "the"', None, "été the"])
    found, sources = secrets.corpus_counts(docs)
    assert found == ["the"] and sum(1 for s in sources.values() if s) == 1


def test_labelled_findings_as_input(spark):
    r = random.Random(4)
    run = lambda letters: "".join(r.choice(letters) for _ in range(24))
    texts = [f"value {run('0123456789abcdef')} here" for _ in range(60)] + [f"value {run('GHIJKLMNOPQRST')} here" for _ in range(60)] + ["same " + "f" * 30 + " same " + "f" * 30, "k" * 300_000 + "9"]
    docs = docs_of(spark, texts)
    labelled = spark.createDataFrame([(k, 6, int(k < 60)) for k in range(120) if k % 2] + [(1, 6, 1), (None, 6, 1), (9, None, 1)], "doc_id long, start long, label int")
    rows = secrets.scan(docs, labelled).collect()
    held = [x for x in rows if x.doc_id < 120 and x.doc_id % 2 == 0]
    assert len(held) == 60 and all(x.secret == (x.doc_id < 60) for x in held)
    assert sorted(x.start for x in rows if x.doc_id == 120) == [5, 41] and [x.length for x in rows if x.doc_id == 121] == [300_001]


# 3


def test_rows_are_kept_by_their_own_text(spark):
    good = "\n".join(" ".join(words(k, 12, 500)) + " of the and in to." for k in range(12))
    docs = docs_of(spark, [good, "bad", None, good.replace("w", "v"), "$$ %% " * 50, ""], [1, 1, 1, None, None, 2])
    kept = quality.keep_good(docs)
    judged = quality.judge_quality(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, good), (-1, good.replace("w", "v"))])
    assert judged.where("kept").count() == 2


# 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(spark, name):
    path, texts = public_tokenizers.path(name), corpus(3, 12)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(library.encode(t or "", num_threads=1)) for t in texts]
    else:
        library = Tokenizer.from_file(path)
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert not token_counts.WordCounter.serves(path) and token_counts.WordCounter.serves(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(spark, texts), path, shared.shared_path(spark, "cache")).collect()}
    assert [rows[k] for k in range(len(texts))] == want


def test_counts_where_one_text_is_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT", 10)
    path, texts = public_tokenizers.path("word_bpe_49k.json"), [*corpus(4, 12), *["Once more, the same text."] * 20, *[None] * 10]
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(texts))]
    library = Tokenizer.from_file(path)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts, strict=True))
    counted = token_counts.count_tokens(docs_of(spark, texts, ids), path, shared.shared_path(spark, "cache"))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counted.collect()) == want


def test_two_runs_share_a_cache(spark, tmp_path, sf_dir, monkeypatch):
    from platen.llm import queries

    spark.conf.set(queries.TOKEN_CACHE, str(tmp_path / "counts"))
    try:
        first = sorted(map(tuple, queries.op4_token_counts(spark, sf_dir).collect()), key=str)
        stored = token_counts.read_cache(spark, str(tmp_path / "counts")).count()
        assert sorted(map(tuple, queries.op4_token_counts(spark, sf_dir).collect()), key=str) == first
        assert token_counts.read_cache(spark, str(tmp_path / "counts")).count() == stored > 0
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


# 6


def test_another_pattern_takes_the_exact_way():
    import base64

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\w+ |\S+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(path, pattern)
    for text in corpus(5, 20):
        assert own.encode(text or "").tolist() == library.encode_ordinary(text or "")


# 7


@pytest.mark.parametrize("hot", [0, 4096])
def test_suffix_dedup_of_repeated_and_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    p = noise(200)
    texts = [p, p + noise(80), noise(300), p + noise(20), noise(40) + p[20:150] + noise(90), p, "x" + p[:90]]
    ids = [1, 7, 7, 9, 9, None, 3]
    rows = suffix_dedup.remove_repeats(docs_of(spark, texts, ids)).collect()
    first = {}
    for i, t in sorted((i, t) for i, t in zip(ids, texts, strict=True) if i is not None):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i or -1, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    assert sorted((x.doc_id or -1, bytes(x.kept).decode()) for x in rows) == sorted(want)


def test_suffix_dedup_by_hash_alone(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    texts = corpus(7, 30) + ["ab" * 400, "ab" * 300, "z" * 2000, "y" + "z" * 60]
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    for i, (kept, spans) in brute_repeats(texts, range(len(texts))).items():
        assert bytes(rows[i].kept) == kept and len(rows[i].spans) == spans, i


# 9


def test_odd_labels(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["calm", "lake", "tree", "hill", "road"]) for _ in range(20)) + (" scum idiot" if k % 3 == 0 else "") for k in range(90)] + ["calm lake", "other text of the id"]
    docs = docs_of(spark, texts, [*range(90), 4, 4])
    rows = [(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (5, None), (7, 1), (7, 0), (10**6, 1)]
    index = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    again = toxicity.fit(docs.repartition(5), spark.createDataFrame(rows[::-1], "doc_id long, toxic int"))
    assert index.ids.tolist() == again.ids.tolist() and index.toxic[index.ids == 7].tolist() in ([1], [])
    held = spark.createDataFrame([(None,), (4,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert [x.h for x in held] == [False, zlib.crc32(b"4") % 3 == 1]


def test_lookup():
    r = random.Random(1)
    import numpy as np

    for n in (0, 1, 7, 5000):
        known = np.unique(np.array([r.randrange(2**64) for _ in range(n)], np.uint64))
        asked = np.concatenate([known[::2], np.array([r.randrange(2**64) for _ in range(50)] + [0], np.uint64)])
        want = [int(np.searchsorted(known, x)) if x in known else -1 for x in asked]
        assert toxicity.Lookup(known).find(asked).tolist() == want


# All


def test_clashing_names_everywhere(spark, tmp_path):
    names = ["n", "token", "node", "key", "version", "copy_doc", "copy_key", "gone_lines", "gone_doc", "lines_removed", "quality_features", "_row", "_gone", "_doc", "_out", "_rejected", "start", "name", "at", "score", "probability", "rate", "copies", "topic", "n_tokens", "tokens", "component_id", "kept", "N_Words"]
    good = "\n".join(" ".join(words(k, 12, 500)) + " of the and in to." for k in range(12))
    frame = spark.createDataFrame([(k, f"{good} {k}", "en", "a", 3, *["x"] * len(names)) for k in range(3)], SCHEMA + ", " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, frame, None).columns == frame.columns and stage(spark, frame, None).count() > 0
    assert ngram_join.near_duplicates(frame).count() == 3 and secrets.scan(frame).count() >= 0
    assert line_dedup.dedup_lines(frame).columns == [*(c for c in frame.columns if c != "lines_removed"), "lines_removed"]
    assert mixing.mix(frame).count() == 3 and media.media_columns(frame).count() == 3
    assert suffix_dedup.remove_repeats(frame).count() == 3
    assert token_counts.count_tokens(frame, public_tokenizers.path("word_bpe_49k.json"), shared.shared_path(spark, "cache")).count() == 3
    assert bpe.bpe_encode(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 3
    labels = frame.select("doc_id", F.lit(1).alias("toxic"), "score")
    assert toxicity.score(frame, toxicity.fit(frame, labels)).count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("S", (), {"conf": type("F", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": Context})
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(session)


def test_long_texts_in_small_slices():
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["a" * 3_000_000, None, "b c"]})
    lengths = [part.num_rows for part, _, _ in __import__("platen.llm.textbytes", fromlist=["slices"]).slices(batch)]
    assert lengths == [1, 2]


def test_media_of_many_texts_in_one_batch(spark):
    """Texts that fill one slice, whose stored bytes fill more than one."""
    texts = [f"text {k} " * (3 * (k % 50) + 1) for k in range(1000)]
    docs = docs_of(spark, texts).coalesce(1)
    rows = {r.doc_id: r for r in media.media_columns(docs).drop("fp_time", "fp_hash").collect()}
    assert len(rows) == len(texts)
    for k in range(0, len(texts), 7):
        data = texts[k].encode()
        full = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert media.samples_of(rows[k].media) == full and rows[k].n_bytes == len(data) and rows[k].payload_sha256 == hashlib.sha256(full).hexdigest()


def test_ids_outside_the_vocabulary_are_an_error(spark):
    for wrong in (-1, 10**6):
        encoded = spark.createDataFrame([(1, [0, wrong])], "doc_id long, ids array<int>")
        with pytest.raises(Exception, match="no such token"):
            bpe.bpe_decode(encoded, BPE).collect()
    assert bpe.bpe_decode(spark.createDataFrame([(1, []), (2, None)], "doc_id long, ids array<int>"), BPE).where("decoded = X''").count() == 2


GIVEN = {
    'secret_key = "hunter2!"': ["hunter2!"],
    "SECRET_KEY=pa$$": ["pa$$"],
    'pass = "Tr0ub4dor"': ["Tr0ub4dor"],
    "PASS: hunter22": ["hunter22"],
    "Authorization: Bearer abc.def": ["abc.def"],
    "--password hunter2": ["hunter2"],
    "run -x --api-key abcd9 --verbose": ["abcd9"],
    "the password is hunter2": ["hunter2"],
    "ssh_key=abcd9": ["abcd9"],
    'token := "abcd9"': ["abcd9"],
    'token => "abcd9"': ["abcd9"],
    "<password>hunter2</password>": ["hunter2"],
    "mysql://u:p/w@h": ["p/w"],
    "encryption_key: zz99": ["zz99"],
    'passphrase="correct horse battery"': ["correct horse battery"],
    '{"api_key": "abcd1234"}': ["abcd1234"],
    "compass: north, monkey: banana, keypad = 1234": [],
    "a password is": [],
    "well-known - token": [],
    "token=abc": [],
}


@pytest.mark.parametrize("text", GIVEN)
def test_spellings_of_given_secrets(text):
    data = text.encode()
    assert [data[a:z].decode() for a, z in secrets.spans_of(data)] == GIVEN[text]


def planted_secrets(seed, n):
    """(text, start, label): one finding in each text, of many kinds; harmless ones stand in the same places."""
    r = random.Random(seed)
    word = lambda: r.choice(["river", "green", "paper", "winter", "market", "window", "garden", "yellow", "letter", "number", "people", "summer"])
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    mixed = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    frames = ['api_key = "{}"', "export SECRET_KEY={}", "password: {}", "curl -H 'Authorization: Bearer {}' host", "tool --token {} --verbose", "postgres://app:{}@db/x", "<password>{}</password>", 'access_token => "{}"', "the password is {}"]
    good = [lambda: chars(mixed, r.randint(18, 40)), lambda: chars("0123456789abcdef", 40), lambda: chars(mixed + "!$%&*", r.randint(9, 14)), lambda: "ghp_" + chars(mixed, 30)]
    bad = [word, lambda: word() + "_" + word(), lambda: "<your-" + word() + "-here>", lambda: "None" + r.choice(["", "()"]), lambda: "${" + word().upper() + "}", lambda: "example", lambda: chars("123456789", 4)]
    out = []
    for _ in range(n):
        label = r.random() < 0.5
        value, frame = r.choice(good if label else bad)(), r.choice(frames)
        head = " ".join(word() for _ in range(r.randint(0, 12))) + "\n"
        out.append((head + frame.format(value) + "\n" + word(), len((head + frame.split("{}")[0]).encode()), int(label)))
    return out


def test_planted_secrets_precision_and_recall(spark):
    rows = planted_secrets(2, 900)
    docs = docs_of(spark, [t for t, _, _ in rows])
    labelled = spark.createDataFrame([(k, at, label) for k, (_, at, label) in enumerate(rows) if k % 2], "doc_id long, start long, label int")
    found = {(x.doc_id, x.start): x.secret for x in secrets.scan(docs, labelled).collect()}
    held = [(k, at, label) for k, (_, at, label) in enumerate(rows) if k % 2 == 0]
    assert all((k, at) in found for k, at, label in held if label)  # no planted secret is lost before the forest
    hits = sum(found.get((k, at), False) for k, at, label in held if label)
    wrong = sum(found.get((k, at), False) for k, at, label in held if not label)
    assert hits >= 0.95 * sum(label for _, _, label in held) and hits >= 0.95 * (hits + wrong)


def test_repeated_rows_repeat_their_findings(spark):
    text = 'password = "hunter2!"'
    rows = secrets.scan(docs_of(spark, [text, text, text], [5, 5, 6])).collect()
    assert sorted((x.doc_id, x.start, x.finding) for x in rows) == [(5, 12, "hunter2!"), (5, 12, "hunter2!"), (6, 12, "hunter2!")]
    wide = secrets.scan(docs_of(spark, ["é password = ñandú99"])).first()
    assert (wide.start, wide.length, wide.finding) == (len("é password = ".encode()), 7, "ñandú99")

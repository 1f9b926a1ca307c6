"""Language identification, spelling variants and conversation repair: against slow versions, held-out labels and odd rows."""

import hashlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("platen.llm")

from platen.llm import language, queries, repair, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA).repartition(3)


# 11

WORDS = {"aa": ["ba", "bo", "kami", "loru", "mito", "saba"], "bb": ["strx", "vrkt", "zlpt", "krst", "pfnt", "tsch"], "cc": ["дом", "река", "небо", "хлеб", "весна"]}


def sentences(seed, n):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 40))), lang) for k in range(n) for lang in [r.choice(sorted(WORDS))]]


def slow_slots(text, slots):
    """Counts of n-grams by slots, one n-gram after another."""
    letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    folded = " " + " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in letters.split(" ") if w)
    folded += "" if folded == " " else " "
    out = np.zeros(slots)
    for n in range(1, language.N + 1):
        for at in range(len(folded) - n + 1):
            gram = folded[at : at + n]
            if gram == " ":
                continue
            h = 0
            for k, c in enumerate(gram, 1):
                h = (h + ord(c) + k) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            out[(h * 0x85EBCA77 % 2**32) >> (33 - slots.bit_length())] += 1
    return out, any(c.isalpha() for c in text)


@pytest.mark.parametrize("text", ["", "a", "Ab cD", "  x--y  ", "ÀÉ ñ́ ö", "12 34 !", "İstanbul ΣΑΣ", "x" * 700, "one two\nthree " * 90, "日本語 と English"])
def test_ngram_counts(text, monkeypatch):
    want, lettered = slow_slots(text, 1 << 10)
    for piece in (64, 1 << 18):
        monkeypatch.setattr(language, "PIECE", piece)
        counts, known = language.counts_of(pa.array([None, text, text], pa.large_string()), 1 << 10)
        assert known.tolist() == [False, lettered, lettered] and not counts[0].any()
        assert (counts[1] == want).all() and (counts[2] == want).all()


def test_nearest_centroids_by_slow_cosines(spark):
    rows = sentences(3, 240)
    docs = docs_of(spark, rows)
    model = language.fit(docs, limit=40)
    learn = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    df = sum((slow_slots(t, language.SLOTS)[0] > 0).astype(int) for t, _ in learn)
    assert np.allclose(model.idf, np.log((1 + len(learn)) / (1 + df)) + 1, atol=1e-5)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-5)
    assert all(1 <= (model.owner == k).sum() <= language.CENTROIDS for k in range(3))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i, text, _ in rows[:40]:
        counts, _ = slow_slots(text, language.SLOTS)
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        cosines = model.vectors @ (v / np.linalg.norm(v))
        assert found[i].nearest == model.languages[model.owner[cosines.argmax()]] and abs(found[i].cosine - cosines.max()) < 1e-4
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].nearest == lang and found[i].score > 0.5 for i, lang in held)


def test_several_centroids_separate_two_scripts_of_one_language(spark):
    mixed = [(k, t, "mix" if lang != "aa" else "aa") for k, t, lang in sentences(5, 300)]
    model = language.fit(docs_of(spark, mixed))
    own = model.vectors[model.owner == model.languages.index("mix")]
    assert (own @ own.T).min() < 0.2  # one near each script, and no mean of both


def test_language_odd_rows(spark):
    rows = sentences(7, 90)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12, 34!", "bb"), (903, "kami loru mito saba", None), (903, "kami loru mito saba", None), (None, "vrkt zlpt krst", "aa"), (904, "kami " * 30000, "aa"), (905, "漢字仮名", None), (906, "x", "aa")]
    docs = docs_of(spark, rows + odd).withColumnRenamed("source", "Nearest")
    found = language.identify(docs, language.fit(docs)).collect()
    assert len(found) == len(rows) + len(odd)
    at = {}
    for r in found:
        at.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and (r.nearest is None) == (r.doc_id in (900, 901, 902))
    assert all((r.lang, r.score, r.rejected) == ("und", 0.0, True) for k in (900, 901, 902) for r in at[k])
    assert len(set(at[903])) == 1 and at[903][0].nearest == "aa" and at[None][0].nearest == "bb" and at[904][0].nearest == "aa"
    assert at[905][0].rejected and at[905][0].lang == "und" and not at[903][0].rejected


def test_language_without_anything_to_learn(spark):
    nothing = docs_of(spark, [(1, "some text", None), (2, None, "aa")])
    assert {(r.doc_id, r.lang, r.nearest, r.score) for r in language.identify(nothing, language.fit(nothing)).collect()} == {(1, "und", None, 0.0), (2, "und", None, 0.0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, language.fit(empty)).count() == 0
    blank = docs_of(spark, [(k, "12 34", "aa") for k in range(6)])
    assert {r.lang for r in language.identify(blank, language.fit(blank)).collect()} == {"und"}


def test_language_sample_is_bounded_and_counts_copies_once(spark):
    rows = [(k, "the same text", "aa") for k in range(2000)] + [(2000 + k, f"text number {k}", "aa") for k in range(400)]
    found = language.examples(docs_of(spark, rows).select("lang", "text"), 50).collect()
    assert 40 <= len(found) <= 50 and len({r.text for r in found}) == len(found)


def test_language_query_held_out_accuracy(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op11_language_id(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


# 12


def near(a, b):
    """Whether one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(counts):
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    forms = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, n, forms[w], root(w), len(around[w]), counts.get(forms[w])) for w, n in counts.items()}


def slow_words(rows):
    counts = {}
    for i, text, _ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def got(df):
    return {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_random_words(spark, seed):
    r = random.Random(seed)
    letters = "abéÿ"
    counts = {}
    for _ in range(40):
        word = "".join(r.choice(letters) for _ in range(r.randint(7, 12)))
        counts[word] = r.choice([2, 20, 200, 2000])
        for _ in range(12):
            at = r.randrange(len(word) + 1)
            kind = r.random()
            word = word[:at] + ("" if kind < 0.3 else r.choice(letters)) + word[at + (kind < 0.7) :]
            if len(word) >= 7:
                counts[word] = r.choice([2, 3, 20, 200])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group_variants(words)) == slow_variants(counts)


def test_every_edit_of_a_word_is_found(spark):
    word = "abcdefghijk"
    edits = {word[:k] + word[k + 1 :] for k in range(11)} | {word[:k] + "z" + word[k + 1 :] for k in range(11)} | {word[:k] + "z" + word[k:] for k in range(12)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in {word} | edits], "word string, n long")).collect()
    assert {p.b for p in pairs if p.a == word} == edits
    assert {(p.a, p.b) for p in pairs} == {(p.b, p.a) for p in pairs} == {(a, b) for a in edits | {word} for b in edits | {word} if near(a, b)}


def test_variant_chains_and_ties(spark):
    counts = {"letters": 3, "lettess": 30, "lettass": 300, "litters": 30, "lutters": 30, "zzzzzzz": 5, "étoiles": 2, "etoiles": 20}
    rows = {r.word: r for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == slow_variants(counts)
    assert (rows["letters"].form, rows["letters"].root) == ("lettess", "lettass")  # of three of 30 the smallest, and on from there
    assert (rows["zzzzzzz"].form, rows["zzzzzzz"].root, rows["zzzzzzz"].n_near) == (None, "zzzzzzz", 0)


def test_words_of_odd_texts(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Straßen STRAßEN straßen don't", "a"), (None, "nothing nothing", "a"), (3, "Straßen STRAßEN straßen don't", "a"), (4, "a" * 40000 + " " + "a" * 39999, "a"), (5, "ab×cd÷ef ab×cd÷ef 1234567 Ünterün", "a"), (6, "a" * 40000 + " " + "a" * 39999, "a")]
    rows += [(10 + k, "whisper forward signals " * 3, "a") for k in range(40)]
    docs = docs_of(spark, rows).withColumnRenamed("lang", "Word").withColumnRenamed("source", "n")
    assert got(spelling.group_variants(spelling.counted(spelling.misspelt(spelling.occurrences(docs))))) == slow_variants(slow_words(rows))
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.group_variants(spelling.counted(spelling.misspelt(spelling.occurrences(empty)))).count() == 0


def test_spelling_query_equals_its_sql(spark, sf_dir):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = set(c.execute(f"SELECT word, n, form, root, n_near, form_n FROM ({queries.ORACLES['op12_spelling_variants']})").fetchall())
    assert got(queries.op12_spelling_variants(spark, sf_dir)) == want


# 13

TURNS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def slow_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired turns) of one conversation's rows in order: all edit sequences, memoised."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        chars = BLANK.findall(text)
        faults.append("b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    memo = {}

    def goes(state, initial):  # states: what the last role was; "" for nothing
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 and initial != ""

    def best(i, state, put):
        if (i, state, put) not in memo:
            found = []
            if i == len(rows) and state in ("", "a"):
                found.append((0, "", ()))
            if put < 3:
                for role in ("user", "assistant"):
                    if goes(state, role[0]):
                        cost, audit, out = best(i, role[0], put + 1)
                        found.append((cost + 2, "I" + audit, ((role, ""), *out)))
            if i < len(rows):
                _, _, role, text = rows[i]
                cost, audit, out = best(i + 1, state, 0)
                found.append((cost + 3, "D" + audit, out))
                if faults[i] not in ("b", "d"):
                    for edit, more, new in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                        if goes(state, new[:1]):
                            cost, audit, out = best(i + 1, new[:1], 0)
                            found.append((cost + more + (faults[i] == "t"), edit + audit, ((new, text), *out)))
            memo[i, state, put] = min(found, default=(10**9, "", ()))
        return memo[i, state, put]

    for i in range(len(rows), -1, -1):  # the last rows first: a shallow stack
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, out = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, out


def slow_summary(rows, damage=False):
    kept = slow_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = set()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        *facts, turns = slow_repair(own)
        out.add((conv, *facts, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()))
    return out


def summary(df):
    return {(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def chats(seed, n=60):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = r.randrange(3)
        for _ in range(r.randint(1, 9)):
            turn += r.choice([1, 1, 1, 2, 4])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, r.choice(["Yes.", "No", "Why?", "  ", "", None, "Fine!\n", "Long text. And more", f"Only here {turn}."])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repair_by_all_edit_sequences(spark, seed):
    rows = chats(seed)
    assert summary(repair.repair_structure(spark.createDataFrame(rows, TURNS).repartition(4))) == slow_summary(rows)
    assert summary(repair.repair_structure(repair.damaged(spark.createDataFrame(rows, TURNS)), copies="copies")) == slow_summary(rows, damage=True)


def test_repair_state_across_chunks_and_batches(spark, monkeypatch):
    r = random.Random(8)
    rows = [(5, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"Text {t}.", f"Open {t}", ""])) for t in range(700)] + [(6, 0, "user", "Hi.")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(repair, "CHUNK", 16)
    spark.conf.set(key, "7")
    try:
        assert summary(repair.repair_structure(spark.createDataFrame(rows, TURNS))) == slow_summary(rows)
    finally:
        spark.conf.set(key, before)


def test_chunks_are_bounded_and_cover_all_rows():
    import pandas as pd

    rows = [("1", t, True, "user", 0, 0, 1, False, False, False) for t in range(200_000, 0, -1)]
    names = ["key", "turn", "has_turn", "role", "h0", "h1", "copies", "blank", "truncated", "earlier"]
    frames = [pd.DataFrame(rows[k : k + 30_000], columns=names) for k in range(0, len(rows), 30_000)]
    made = pd.concat(list(repair._backward(iter(frames))))
    sizes = made["edits"].map(len).tolist()
    assert max(sizes) == repair.CHUNK and sum(sizes) == len(rows) and made["illegal"].tolist()[-1] == len(rows) - 1 and made["turn"].tolist()[-1] == 1


def test_repair_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "user", "Are you there?"), (2, 4, "tool", "Out."), (3, 1, "user", " ")]
    found = sorted((r.conv_id, r.position, r.turn, r.role, r.text, r.edit) for r in repair.repair_turns(spark.createDataFrame(rows, TURNS)).collect() if r.turn is not None)
    all_rows = repair.repair_turns(spark.createDataFrame(rows, TURNS)).collect()
    for conv in (1, 2):
        turns = [(x.role, x.text) for x in sorted((r for r in all_rows if r.conv_id == conv), key=lambda r: r.position)]
        assert tuple(turns) == slow_repair([r for r in rows if r[0] == conv])[-1]
    assert not [r for r in all_rows if r.conv_id == 3] and found[0] == (1, 0, 0, "system", "Be kind.", "K")


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Null id."), (7, None, "user", "First."), (7, None, "user", "First."), (7, 2**62, "assistant", "Far."), (7, -(2**62), "user", "First."), (8, 1, "assistant", "x." * 200_000), (9, 1, "User", "A."), (9, 1, "User", "A."), (9, 2, "user ", "A.")]
    odd = spark.createDataFrame([(*r, 5, "e") for r in rows], TURNS + ", copies int, Key string")
    assert summary(repair.repair_structure(odd)) == slow_summary(rows)
    assert summary(repair.repair_structure(repair.damaged(odd), copies="copies")) == slow_summary(rows, damage=True)
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_structure(empty).count() == 0 and repair.repair_turns(empty).count() == 0


def test_conversation_query_by_all_edit_sequences(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summary(queries.op13_conversation_repair(spark, sf_dir)) == slow_summary(rows, damage=True)

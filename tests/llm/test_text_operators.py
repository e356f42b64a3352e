"""Corpus operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.llm import class_lm, decontamination, language_id, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " \n\t", "a", "!!! ...", "one two three four", "é — “q” \x1c x İ", "Wher. " * 400, "x" * 5000]


def words(rng, n, pool):
    return [rng.choice(pool) for _ in range(n)]


def make_docs(seed=3, n=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéz") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    shared = " ".join(words(rng, 60, pool))
    docs: list[str | None] = list(AWKWARD)
    while len(docs) < n:
        k = len(docs) % 8
        text = " ".join(words(rng, rng.randint(0, 150), pool))
        if k == 1:
            text = " ".join([*words(rng, 20, pool), shared, *words(rng, 20, pool)])
        elif k == 2:
            text = shared[rng.randint(0, 30) :] + " tail"
        elif k == 3:
            text = (" ".join(words(rng, 15, pool)) + " ") * 3
        elif k == 4:
            text = rng.choice(docs)
        elif k == 5 and docs[-3]:
            text = docs[-3][: len(docs[-3]) // 2] + "X" + docs[-3][len(docs[-3]) // 2 :]
        elif k == 6:
            text = "Line one here\nline two\nLine one here\n\n" + text + " ### | $%&"
        docs.append(text)
    return docs


def frame(spark, docs, extra=()):
    rows = [(i if i != 11 else None, t, ("en", "fr", None)[i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(docs)]
    return spark.createDataFrame([*rows, *extra], DOCS).repartition(5)


@pytest.fixture(scope="module")
def texts():
    return make_docs()


def ids(rows, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in columns)) for r in rows))


def removed_by_hand(docs, length):
    raws = [(t or "").encode() for t in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    kept = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept.append(bytes(c for c, g in zip(r, gone, strict=True) if not g))
    return kept


@pytest.mark.parametrize(("length", "hot"), [(50, 100_000), (100, 3), (90, 60)])
def test_suffix_dedup(spark, texts, length, hot):
    extra = [(7, texts[12], None, None, 0)] * 2  # a repeated row
    got = suffix_dedup.remove_repeats(frame(spark, texts, extra).withColumn("spans", F.lit("clash")), length=length, hot=hot).collect()
    kept = removed_by_hand([*texts, texts[12], texts[12]], length)
    keys = [*(None if i == 11 else i for i in range(len(texts))), 7, 7]
    assert ids(got, "kept") == sorted((k is None, k or 0, v) for k, v in zip(keys, kept, strict=True))
    for r in got:
        assert r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"])


def test_short_runs_stay_and_characters_go_whole(spark):
    """min_words and characters against runs found by hand."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcé日") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    long, short = " ".join(words(rng, 55, pool)), " ".join(words(rng, 30, pool))
    docs = [None, "", *(f"{' '.join(words(rng, 40, pool))} é{s}é {' '.join(words(rng, 40, pool))}" for s in (long, long, short, short, "日" + long[1:]))]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, docs), length=100, min_words=50, characters=True).collect()}
    runs = {r["doc_id"]: r["spans"] for r in suffix_dedup.remove_repeats(frame(spark, docs), length=100).collect()}
    for i, t in enumerate(docs):
        raw = (t or "").encode()
        expected = [suffix_dedup.whole_characters(raw, s["start"], s["end"]) for s in runs[i] if len(raw[s["start"] : s["end"]].split()) >= 50]
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == expected
        got[i]["kept"].decode()  # what is left is whole characters
    assert [len(runs[i]) for i in range(len(docs))] == [0, 0, 1, 1, 1, 1, 1] and [len(got[i]["spans"]) for i in range(len(docs))] == [0, 0, 1, 1, 0, 0, 1]


def passages_by_hand(docs, over):
    """(passages, words in them) of each text."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in docs]
    seen = Counter(tuple(w[i : i + over + 1]) for w in split for i in range(len(w) - over))
    found = []
    for w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - over):
            if seen[tuple(w[i : i + over + 1])] > 1:
                gone[i : i + over + 1] = b"\1" * (over + 1)
        found.append((sum(len(r) > 0 for r in gone.split(b"\0")), sum(gone)))
    return found


@pytest.mark.parametrize(("over", "hot"), [(50, 100_000), (20, 100_000), (40, 3)])
def test_repeated_passages_of_words(spark, texts, over, hot):
    """Passages of few bytes are counted, and stay in what is left."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    at_50, at_51 = words(rng, 50, pool), words(rng, 51, pool)
    docs = [*texts, *(" \n".join([*words(rng, 30, pool), *p, *words(rng, 30, pool)]) for p in (at_50, at_50, at_51, at_51)), " ".join(at_51)]
    docs += [t.replace(" ", "\t ") for t in docs[-2:]]
    got = suffix_dedup.remove_repeats(frame(spark, docs, [(7, docs[-1], None, None, 0)] * 2), length=400, hot=hot, passages_over=over).collect()
    expected = passages_by_hand([*docs, docs[-1], docs[-1]], over)
    keys = [*(None if i == 11 else i for i in range(len(docs))), 7, 7]
    assert ids(got, "n_passages", "n_passage_words") == sorted((k is None, k or 0, *v) for k, v in zip(keys, expected, strict=True))
    if over == 50:
        one = next(r for r in got if r["doc_id"] == len(texts) + 2)
        assert (one["n_passages"], one["n_passage_words"], one["spans"]) == (1, 51, []) and not expected[len(texts)][0]


def test_repeats_in_a_very_long_text(spark):
    """Repeats inside and across the pieces that a text over 4 MiB is worked on in."""
    rng = np.random.default_rng(9)
    alphabet = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     \n", np.uint8)
    raw = bytearray(alphabet[rng.integers(0, len(alphabet), suffix_dedup.SEGMENT + 300_000)].tobytes())
    passage = alphabet[rng.integers(0, len(alphabet), 500)].tobytes()
    places = [1_000, suffix_dedup.SEGMENT - 250, suffix_dedup.SEGMENT + 200_000]
    for at in places:
        raw[at : at + 500] = b"#" + passage[1:-1] + bytes([at % 251])  # other bytes at either end
    text = raw.decode("latin-1").encode("ascii", "replace").decode()
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, [text, "x", passage[100:499].decode()]), length=400).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(at, at + 499) for at in places]
    assert not got[1]["spans"] and not got[2]["spans"]


def test_copies_are_sorted_once(spark, texts):
    """Owners of a passage, as many as it has copies, stay out of the task that sorts it."""
    copies = [texts[12]] * 2500 + texts[:30]
    found = suffix_dedup.remove_repeats(frame(spark, copies), length=50)
    sorts = [x for x in found._jdf.queryExecution().analyzed().toString().split("\n") if "MapInArrow sort(" in x]
    assert sorts and not any("owners" in x for x in sorts)
    assert ids(found.collect(), "kept") == sorted((i == 11, 0 if i == 11 else i, v) for i, v in enumerate(removed_by_hand(copies, 50)))


def test_near_duplicates(spark, texts):
    df = frame(spark, texts).withColumn("class_id", F.lit("clash"))
    got = near_dedup.near_duplicates(df).collect()
    weights = near_dedup.Weights(near_dedup.document_frequencies(df))
    sets = [weights.shingles((t or "").encode()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and (texts[i] == texts[j] or near_dedup.similarity(sets[i], sets[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    classes = {}
    for i in range(len(texts)):
        if i != 11 and len(sets[i][0]):
            classes.setdefault(root(i), set()).add(i)
    found = {}
    for r in got:
        if r["class_key"] is not None and r["doc_id"] is not None:
            found.setdefault(r["class_key"], set()).add(r["doc_id"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))
    firsts = Counter(r["class_key"] for r in got if r["is_first"] and r["class_key"] is not None)
    assert set(firsts) == {r["class_key"] for r in got if r["class_key"] is not None}
    kept = near_dedup.kept_documents(df.unionByName(df))
    assert kept.where("length(text) > 20").count() == len({r["class_key"] for r in got if r["text"] and len(r["text"]) > 20 and r["class_key"] is not None})


def weighted_by_hand(texts):
    """Shingle weights and weighted Jaccard similarity with words and tuples: 1 to 2, by the mean rarity of a shingle's words, times the count."""
    cut = [(t or "").encode().lower().split() for t in texts]
    df = Counter(w for ws in cut for w in set(ws))

    def rarity(word):
        return min(max(1 + math.log(len(texts) / df[word]) / math.log(1000), 1.0), 2.0)

    def weights(ws):
        n = min(5, len(ws))
        counts = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()
        return {s: c * sum(map(rarity, s)) / len(s) for s, c in counts.items()}

    def alike(a, b):
        common = sum(min(v, b[s]) for s, v in a.items() if s in b)
        return common / (sum(a.values()) + sum(b.values()) - common)

    return [weights(ws) for ws in cut], alike


def test_similarity_by_hand(spark, texts):
    sets, alike = weighted_by_hand(texts)
    found = near_dedup.Weights(near_dedup.document_frequencies(frame(spark, texts)))
    own = [found.shingles((t or "").encode()) for t in texts]
    assert [len(s) for s in sets] == [len(k) for k, _ in own]
    compared = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                s = alike(sets[i], sets[j])
                compared += 0 < s < 1
                assert near_dedup.similarity(own[i], own[j]) == pytest.approx(s, abs=1e-5)
    assert compared > 100


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 1 << 62, 1000, dtype=np.uint64)
    a = (np.sort(keys[:900]), np.full(900, 1.5, np.float32))
    b = (np.sort(keys[100:]), np.full(900, 1.5, np.float32))
    sampler = near_dedup.Sampler(bands=400, rows=1)
    agree = (sampler.band_keys([a])[0] == sampler.band_keys([b])[0]).mean()
    assert abs(agree - near_dedup.similarity(a, b)) < 0.08
    assert (sampler.band_keys([a, b])[0] == sampler.band_keys([a])[0]).all()


def test_language_id(spark):
    rows = [(i, ("the cat and the dog ran" if i % 2 else "le chat et les chiens ont") + f" {i}", "en" if i % 2 else "fr", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows + [(98, "the dog", None, None, 0)], DOCS)
    profiles = language_id.learn_profiles(docs)
    assert set(profiles) == {"en", "fr"} and all(len(p) <= 300 for p in profiles.values())
    test = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate([*AWKWARD, "the dogs and cats", "les chats et le chien"])], DOCS).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.identify(test, profiles).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 4)] == ["und"] * 4 and got[0]["score"] == 0
    assert (got[9]["lang_pred"], got[10]["lang_pred"]) == ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(test, {}).collect()} == {"und"}


def profile_by_hand(texts, size=300):
    """The most frequent n-grams of padded words; ties go to the smaller code."""
    seen = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            if w.isalpha():
                points = [1, *map(ord, w), 1]
                seen.update(points[1:-1])
                seen.update((a << 21) | b for a, b in zip(points, points[1:], strict=False))
                seen.update((a << 42) | (b << 21) | c for a, b, c in zip(points, points[1:], points[2:], strict=False))
    return [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_id_by_hand(spark):
    rng = random.Random(6)
    pools = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 8))) for _ in range(90)] for k, v in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "efghαβ"))}
    known = [(i, " ".join(words(rng, rng.randint(1, 60), pools[k])) + rng.choice(["", " 12!", "\n"]), k, None, 0) for i, k in enumerate(["aa", "bb", "cc", None] * 12) if k]
    known += [(99, None, "aa", None, 0), (98, "3 4", "bb", None, 0), *known[:3]]
    profiles = language_id.learn_profiles(spark.createDataFrame(known, DOCS).repartition(4))
    expected = {k: profile_by_hand([t for _, t, lang, _, _ in known if lang == k]) for k in pools}
    assert profiles == expected
    mixed = [" ".join(words(rng, 40, pools[a]) + words(rng, n, pools[b])) for a in pools for b in pools for n in (5, 30, 40)] + [None, "", "7", "ab"]
    for r in language_id.identify(frame(spark, mixed).drop("lang"), profiles).collect():
        own = profile_by_hand([mixed[11 if r["doc_id"] is None else r["doc_id"]]])
        far = {k: sum(abs(p.index(c) - i) if c in p else 300 for i, c in enumerate(own)) for k, p in expected.items()}
        if not own:
            assert (r["lang_pred"], r["score"], r["distance"]) == ("und", 0.0, 1.0)
            continue
        best, second = sorted(far.values())[:2]
        assert r["lang_pred"] == min(k for k in far if far[k] == best)
        assert r["score"] == pytest.approx(1 - best / (best + second)) and r["distance"] == pytest.approx(best / (300 * len(own)))


def test_long_texts_are_counted_in_parts():
    rng = random.Random(2)
    text = " ".join(words(rng, 400, ["ab", "é", "cde", "x1y", "."])) + "q" * 300 + " end"
    whole, some = language_id.text_counts(text, 3), [language_id.counted(language_id.ngram_codes(p, 3)) for p in language_id.parts(text, 50) if p.strip(" .1")]
    cut = language_id.summed([c for c, _ in some], [n for _, n in some])
    assert len(some) > 10 and all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_rank_order_profile():
    assert language_id.ranked(*language_id.text_counts("aab", 1), 10).tolist() == [ord("a"), ord("b")]
    assert len(language_id.ngram_codes("a b", 3)) == 2 + 4 + 2  # letters, pairs with a gap, triples around a letter


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    file = tokenizer()
    plain = Tokenizer.from_file(file)
    texts = [*texts, "it's WE'LL 4,5!! naïve ΣΑΣ <|endoftext|> ½ 日本", "a <|endoftext|> b", "<|ENDOFTEXT|>x <|startoftext|>", "<|end of text|>"]
    docs = frame(spark, texts).withColumn("offset", F.lit("clash"))
    rows = packing.pack(docs, file, length=64).collect()
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(texts):
        found = sorted(by_doc[None if i == 11 else i], key=lambda r: r["start"])
        ids_ = np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist()
        assert ids_ == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert found[0]["doc_tokens"] == len(ids_)
    for k, parts in places.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert k == max(places) or sum(n for _, n in parts) == 64


def test_pieces_of_no_and_of_several_words():
    file = tokenizer()
    encoder = packing.Encoder(file)
    for text in ("\u00a0 it's", "it's \u00a0 its", "\u3000 we'll"):
        found = np.frombuffer(encoder.encode([text], b"")[0], "<u4").tolist()
        assert found == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_decontamination(spark, texts):
    items = [(0, texts[17]), (1, texts[17]), (2, "one two three four"), (3, None), (4, ""), (None, " ".join((texts[25] or "").split()[3:30])), (2, "twice the same id"), (5, "école deux trois quatre")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [*texts, "ONE Two, three-FOUR", "one two three five", "École DEUX trois quatre", "l'école deux TROIS quatre"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(t):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    expected = {}
    for k, t in enumerate(docs):
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        expected[k] = (len(w), len(hit), sorted(found))
    got = decontamination.contamination(frame(spark, docs).withColumn("n_hit", F.lit("clash")), benchmark).collect()
    assert {(11 if r["doc_id"] is None else r["doc_id"]): (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == expected
    assert any(r["contaminated"] for r in got) and all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_no_documents(spark, texts):
    benchmark = spark.createDataFrame([(1, texts[17])], "item_id long, text string")
    assert decontamination.contamination(frame(spark, []), benchmark).count() == 0


def test_no_benchmark(spark, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.contamination(frame(spark, texts), none).where("contaminated or n_hit > 0").count()


def test_quality_statistics(spark, texts):
    got = {r["doc_id"]: r for r in quality_rules.judged(frame(spark, texts), min_rows=5).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in enumerate(texts):
        if i == 11:
            continue
        w, lines = word.findall(t or ""), [x for x in (t or "").split("\n") if word.search(x)]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("min_rows", [5, 1000])
def test_fences_by_hand(spark, texts, min_rows):
    """Fences of small groups, whose sketches hold every value, and verdicts, from the counts of the rows."""
    import unicodedata

    docs = frame(spark, [t and (t + " " + "filler words " * 40) if i % 5 == 0 else t for i, t in enumerate(texts)])
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r.asDict() for r in quality_rules.judged(docs, min_rows=min_rows, min_words=20).collect()]
    for r in rows:
        chars, n = max(r["word_chars"], 1), max(r["n_words"], 1)
        upper = sum(unicodedata.category(c) == "Lu" for c in text_of[r["doc_id"]] or "")
        r["by_hand"] = {"symbol_share": r["n_symbols"] / chars, "upper_share": upper / chars, "dup_line_share": r["n_dup_lines"] / n, "repeat_share": r["n_repeat_words"] / n, "word_length": r["word_chars"] / n}
    passing = [r for r in rows if not r["base_failed"]]
    own_used = 0
    for r in rows:
        own = [x for x in passing if (x["lang"], x["source"]) == (r["lang"], r["source"])]
        own_used += len(own) >= min_rows
        group = own if len(own) >= min_rows else [x for x in passing if x["lang"] == r["lang"]]
        beyond = False
        for name, floor in quality_rules.FLOORS.items():
            values = sorted(x["by_hand"][name] for x in group)
            low, high = (values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.25, 0.75))
            assert r[f"max_{name}"] == pytest.approx(high + 3 * max(high - low, floor))
            beyond |= r["by_hand"][name] > r[f"max_{name}"]
        assert r["kept"] == (not r["base_failed"] and not beyond)
    assert (own_used > 0) == (min_rows == 5)


def test_fences_follow_the_group(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(3000)]
    rows = [(i, " ".join(words(rng, 80, pool)), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100, " ".join(x + "###" for x in words(rng, 80, pool)), "en", "s0", 0), (101, " ".join(words(rng, 80, pool)), None, None, 0)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, DOCS), min_rows=20).collect()}
    assert not got.pop(100) and all(got.values())


def lm_by_hand(model, counts, n, v, classes):
    """A function that scores a text by the model's own word classes, with all else counted anew."""
    seen = [*counts]
    of = dict(zip(seen, model.classes_of(seen).tolist(), strict=True))

    def class_of(word):
        return of[word] if word in of else int(model.of[model.symbols.symbol(word)])

    def tables(train):
        table, mass, types = np.zeros((classes, classes)), np.zeros(classes), np.zeros(classes)
        for w in train:
            found = [0, *map(class_of, w)]
            for a, b in zip(found, found[1:], strict=False):
                table[a, b] += 1
        for word, c in counts.items():
            mass[of[word]] += c
            types[of[word]] += 1
        return table, mass, types

    def score(train, w):
        table, mass, types = tables(train)
        share = (mass + 1) / (n + classes)
        found = [0, *map(class_of, w)]
        steps = sum(math.log10((table[a, b] + share[b]) / (table[a].sum() + 1)) for a, b in zip(found, found[1:], strict=False))
        return steps + sum(math.log10((counts[x] + 0.5) / (mass[class_of(x)] + 0.5 * (types[class_of(x)] + 1))) for x in w)

    return score


@pytest.mark.parametrize(("head", "core"), [(40, 20), (1000, 30), (5, 1000)])
def test_class_lm(spark, texts, head, core):
    options = {"classes": 8, "head": head, "core": core, "groups": 10}
    docs = frame(spark, texts)
    teaches = (F.col("doc_id") % 5 != 1) | F.col("doc_id").isNull()
    model = class_lm.learn(docs.where(teaches), **options)
    got = class_lm.scored(docs.select("doc_id", "text").withColumn("score", F.lit("clash")), model).collect()
    again = {r["doc_id"]: r for r in class_lm.learned_and_scored(docs.select("doc_id", "text"), teaches, **options).collect()}
    counts, train = Counter(), []
    for i, t in enumerate(texts):
        if i == 11 or i % 5 != 1:
            train.append(class_lm.tokens((t or "").encode()))
            counts.update(train[-1])
    n, v = sum(counts.values()), len(counts)
    score = lm_by_hand(model, counts, n, v, 8)
    assert len(got) == len(texts)
    for k, r in enumerate(got):
        w = class_lm.tokens((texts[11 if r["doc_id"] is None else r["doc_id"]] or "").encode())
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(x in counts for x in w)) and r["score"] < 0
        if k % 6 == 0:
            assert r["score"] == pytest.approx(score(train, w))
        for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"):
            assert r[c] == pytest.approx(again[r["doc_id"]][c])
    assert np.allclose((10**model.transition).sum(1), 1)
    # What follows any class adds up to one over all known words and one unknown of each class.
    mass = Counter()
    for word_, k in zip(counts, model.classes_of([*counts]).tolist(), strict=True):
        mass[k] += counts[word_] + 0.5
    for k, total in mass.items():
        assert (total + 0.5) * 10 ** model.emission[k] == pytest.approx(1)
    assert model.steps == sorted(model.steps) or model.steps[-1] >= model.steps[0]


def test_neighbours_and_moves_by_hand(spark, texts, monkeypatch):
    """Counted neighbours of symbols, and each word's best class, against plain sums."""
    docs = frame(spark, texts)
    n, v, symbols, head_counts = class_lm.counted(docs, 60, 30, 5)
    rows = class_lm.encoded(docs, [], symbols)
    expected = Counter()
    sequences = [[0, *map(symbols.symbol, class_lm.tokens((t or "").encode()))] for t in texts]
    for s in sequences:
        expected.update(zip(s, s[1:], strict=False))
    found = Counter()
    beside = class_lm.neighbours(rows, symbols)
    for r in beside.collect():
        for slot, k in zip(r["slots"], r["ns"], strict=True):
            if slot < symbols.size:
                found[r["symbol"], slot] = k
            else:
                assert expected[slot - symbols.size, r["symbol"]] == k
    assert found == expected
    of = np.append(0, 1 + np.arange(symbols.size - 1) % 5)
    table = class_lm.square(beside, of, 6)
    new = class_lm.moved(beside, of, table)
    flat = np.zeros((6, 6))
    for (a, b), k in expected.items():
        flat[of[a], of[b]] += k
    assert (table == flat).all()
    words_ = class_lm.other_words(rows, symbols, of, table).collect()
    counts = Counter(w for t in texts for w in class_lm.tokens((t or "").encode()))
    assert {bytes(r["word"]): r["c"] for r in words_} == {w: c for w, c in counts.items() if symbols.symbol(w) > symbols.n_own}

    def gains(after, before, old):
        """The likelihood with a word in each class, its neighbours where they are."""
        out = []
        for k in range(6):
            t = table.copy()
            for c, m in before.items():
                t[c, old] -= m
            for c, m in after.items():
                t[old, c] -= m
            t = np.maximum(t, 0)
            sums = t.sum(0), t.sum(1)
            del sums
            gain = sum(class_lm.f(np.array([t[c, k] + m]))[0] - class_lm.f(np.array([t[c, k]]))[0] for c, m in before.items()) + sum(class_lm.f(np.array([t[k, c] + m]))[0] - class_lm.f(np.array([t[k, c]]))[0] for c, m in after.items())
            for side, size in ((0, sum(before.values())), (1, sum(after.values()))):
                rest = table.sum(side)[k] - (size if k == old else 0)
                gain -= class_lm.f(np.array([rest + size]))[0] - class_lm.f(np.array([rest]))[0]
            out.append(gain if k else -np.inf)
        return np.array(out)

    for r in words_[:200]:
        word, after, before = bytes(r["word"]), Counter(), Counter()
        for t, s in zip(texts, sequences, strict=True):
            for i, w in enumerate(class_lm.tokens((t or "").encode())):
                if w == word:
                    before[int(of[s[i]])] += 1
                    if i + 2 < len(s):
                        after[int(of[s[i + 2]])] += 1
        g = gains(after, before, int(of[symbols.symbol(word)]))
        assert g[r["class"]] == pytest.approx(g.max())
    assert new[0] == 0 and (new > 0)[1:].all()
    # The same of short batches whose words are merged, or told, at once.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        for keys, held in ((1, 400_000), (400, 400_000), (10**6, 1)):
            monkeypatch.setattr(class_lm, "KEYS", keys)
            monkeypatch.setattr(class_lm, "HELD", held)
            assert sorted(map(tuple, class_lm.other_words(rows, symbols, of, table).collect())) == sorted(map(tuple, words_))
    finally:
        spark.conf.set(key, before)


def test_rare_words_are_classed_by_their_neighbours(spark):
    """Words of one ending, outside core and head, that stand in two kinds of places."""
    rng = random.Random(4)
    nouns, verbs = ([f"{k}{i}zz" for i in range(40)] for k in ("n", "v"))
    docs = frame(spark, [" ".join(x for _ in range(30) for x in ("the", rng.choice([*nouns, *nouns[:1] * 20]), "to", rng.choice([*verbs, *verbs[:1] * 20]))) for _ in range(60)])
    model = class_lm.learn(docs, classes=5, head=6, core=4, groups=2)
    of = dict(zip(nouns + verbs, model.classes_of([w.encode() for w in nouns + verbs]).tolist(), strict=True))
    assert len({of[w] for w in nouns}) == 1 and len({of[w] for w in verbs}) == 1 and of[nouns[0]] != of[verbs[0]]
    assert model.steps[-1] > model.steps[0]


def test_exchange_finds_alternation():
    big = np.zeros((7, 7))
    for a, b in [(1, 2), (3, 4), (1, 4), (3, 2), (5, 6), (1, 6), (5, 2)]:
        big[a, b] = big[b, a] = 50
    big[0, 1] = big[2, 0] = 1
    of = class_lm.exchange(big, 3)
    assert len({of[i] for i in (1, 3, 5)}) == 1 and len({of[i] for i in (2, 4, 6)}) == 1 and of[1] != of[2]


def test_quality_classifier(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(x.upper() + "!!" if i % 4 == 0 else x for x in words(rng, 60, pool)), None, None, 0) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "", None, None, 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(5, None), (777, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.scored(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == 202 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(0, 200, 5)]
    assert all(got[i]["predicted"] == int(i % 4 > 0) for i in held)
    constant = quality_classifier.scored(docs, labels.where("quality = 1"), F.lit(True)).first()
    assert constant["predicted"] == 1


def statistics_by_hand(text):
    raw = (text or "").encode()
    w, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    size, n = max(len(raw), 1), max(len(w), 1)

    def share(these):
        return sum(c in these for c in raw) / size

    letters, digits = bytes([*range(65, 91), *range(97, 123)]), b"0123456789"
    return {
        "n_bytes": len(raw), "n_words": len(w), "word_length": sum(map(len, w)) / n, "upper_share": share(range(65, 91)), "digit_share": share(digits), "symbol_share": share(b"#$%&*+<=>@[\\]^_`{|}~"),
        "emphasis_share": share(b"!?"), "punct_share": share(bytes(c for c in range(33, 127) if c not in letters + digits)), "high_share": share(range(128, 256)), "line_share": share(b"\n"),
        "distinct_share": len(set(w)) / n, "top_share": max(Counter(w).values(), default=0) / n, "pair_share": len(set(zip(w, w[1:], strict=False))) / max(len(w) - 1, 1),
        "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1),
    }


def test_text_statistics(spark, texts):
    """Each statistic, and the score from the ensemble's rules, against plain Python."""
    docs = frame(spark, texts).withColumn("n_words", F.lit("clash"))
    rows = quality_classifier.with_statistics(docs.select("doc_id", "text", "n_words"))
    labelled = rows.withColumn("label", F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("distinct_share") > 0.7).cast("int")))
    ensemble = quality_classifier.fit(labelled, trees=4)
    assert ensemble.weights
    for r in rows.withColumn("score", ensemble.score()).collect():
        expected = statistics_by_hand(texts[11 if r["doc_id"] is None else r["doc_id"]])
        for k, v in expected.items():
            assert r[k] == pytest.approx(float(v)), k
        total = ensemble.bias + sum(weight for rule, weight in ensemble.weights.items() if all((r[k] <= t) == at_most for k, at_most, t in rule.parts))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_samples_of_least_hash(spark):
    from paneloom.llm.common import least_hashed

    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 2000, 1).otherwise(F.col("id")))  # a third of all rows has one key
    for most in (1, 50, 4999, 9000):
        got = [r["k"] for r in least_hashed(rows, most, "k").collect()]
        assert sorted(got) == sorted(r["k"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(most).collect())
    assert least_hashed(rows.limit(0), 5, "k").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from paneloom.llm.common import shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    assert shared_dir(Session(spark_checkpoint_dir="hdfs:/x", spark_master="yarn")) == "hdfs:/x"
    assert shared_dir(Session(spark_master="local[2]")).startswith("file:")
    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="spark://host:7077"))


def test_texts_of_a_megabyte(spark):
    """Every text operator on texts of about 1 MB: a text, an edited copy of it, one line many times, and a short one."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    long = " ".join(words(rng, 170_000, pool))
    at = long.index(" ", 500_000)
    docs = [long, long[:at] + " changed Here " + long[at + 1 :], "one line of six words here\n" * 40_000, " ".join(words(rng, 60, pool))]
    df = frame(spark, docs)
    cut = [d.split() for d in docs]
    assert all(len(d.encode()) > 1_000_000 for d in docs[:3])

    r = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    assert [(r[i]["n_words"], r[i]["word_chars"]) for i in range(4)] == [(len(w), sum(map(len, w))) for w in cut]
    twice = Counter(zip(cut[0], cut[0][1:], cut[0][2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(cut[0], cut[0][1:], cut[0][2:], strict=False)) if twice[w] > 1 for j in range(3)}
    assert r[2]["n_dup_lines"] == 39_999 and r[2]["n_repeat_words"] == len(cut[2]) and r[0]["n_repeat_words"] == len(covered)

    found = {r["doc_id"]: r for r in language_id.identify(df, language_id.learn_profiles(df)).collect()}
    assert all(found[i]["lang_pred"] != "und" for i in range(4))

    scores = {r["doc_id"]: r for r in class_lm.learned_and_scored(df.select("doc_id", "text"), F.lit(True), classes=6).collect()}
    counts = Counter(w for d in docs for w in class_lm.tokens(d.encode()))
    n, v = sum(counts.values()), len(counts)
    for i, d in enumerate(docs):
        w = class_lm.tokens(d.encode())
        assert scores[i]["n_tokens"] == scores[i]["n_known"] == len(w)
        assert scores[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))

    kept = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, length=400).collect()}
    assert kept[3]["spans"] == [] and kept[2]["kept"] == b"" and kept[0]["kept"] == b""
    middle = len(docs[1][:at].encode())
    assert len(kept[1]["spans"]) == 2 and kept[1]["kept"].strip() in b"changed Here" and len(kept[1]["kept"]) > 8 and kept[1]["spans"][0]["end"] in (middle, middle + 1)

    classes = {r["doc_id"]: r["class_key"] for r in near_dedup.near_duplicates(df).collect()}
    assert classes[0] == classes[1] and len({classes[0], classes[2], classes[3]}) == 3

    benchmark = spark.createDataFrame([(1, " ".join(re.findall("[^ ]+", long)[90_000:90_040])), (2, "six words here one")], "item_id long, text string")
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.contamination(df, benchmark).collect()}
    assert hit[0] == (170_000, 40, ["1"]) and hit[2] == (240_000, 4 * 39_999, ["2"]) and hit[3] == (60, 0, [])

    from tokenizers import Tokenizer

    file = tokenizer()
    plain = Tokenizer.from_file(file)
    pieces = {}
    for r in packing.pack(df, file).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, d in enumerate(docs):
        ids_ = np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4").tolist()
        assert ids_ == [*plain.encode(d, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("operator", [suffix_dedup.remove_repeats, near_dedup.near_duplicates, quality_rules.judged, lambda d: language_id.identify(d, language_id.learn_profiles(d)), lambda d: packing.pack(d, tokenizer()), lambda d: class_lm.scored(d, class_lm.learn(d))])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0


def test_rules_are_the_paths_of_a_forest(spark):
    """Rules against paths walked in the forest's printed form: which nodes a row passes is which rules it fires."""
    import re

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(4)
    names = quality_classifier.STATISTICS
    frame = rng.normal(size=(120, len(names))).round(1)
    rows = spark.createDataFrame([(float(r[0] + r[1] > 0), *map(float, r)) for r in frame], ", ".join(["label double", *[f"`{n}` double" for n in names]]))
    features = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=3, maxDepth=3, seed=1).fit(features)
    rules = quality_classifier.rules_of(forest)
    paths = set()
    for text in re.split(r"Tree \d+ \(weight \S+\):\n", forest.toDebugString)[1:]:
        stack: list[tuple[int, tuple]] = []
        for line in text.splitlines():
            depth = len(line) - len(line.lstrip())
            stack = [s for s in stack if s[0] < depth]
            if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
                stack.append((depth, (int(m[1]), m[2], float(m[3]))))
                paths.add(tuple(s[1] for s in stack))
    assert paths
    fired = rows.select(*[r.column().alias(f"r{i}") for i, r in enumerate(rules)]).toPandas().to_numpy()

    def passes(x, path):
        return all(x[f] <= t if sign == "<=" else x[f] > t for f, sign, t in path)

    by_hand = {tuple(float(passes(x, p)) for x in frame) for p in paths}
    assert {tuple(c) for c in fired.T} == by_hand and len(rules) <= len(paths)


def test_weights_meet_the_conditions_of_the_lasso(spark):
    """At the optimum the mean slope of a rule is lasso times the sign of its weight, and no more than lasso without one."""
    rng = np.random.default_rng(5)
    names = quality_classifier.STATISTICS
    frame = rng.normal(size=(300, len(names))).round(1)
    y = (frame[:, 0] - frame[:, 2] + 0.7 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(k), *map(float, r)) for i, (k, r) in enumerate(zip(y, frame, strict=True))], ", ".join(["doc_id long, label int", *[f"`{n}` double" for n in names]]))
    ensemble = quality_classifier.fit(rows, trees=4, lasso=0.02)
    assert ensemble.weights
    found = rows.select("label", ensemble.score().alias("p"), *[r.column().alias(f"r{i}") for i, r in enumerate(ensemble.weights)]).toPandas()
    off = found["p"] - found["label"]
    assert abs(off.mean()) < 1e-3
    for i, w in enumerate(ensemble.weights.values()):
        assert (off * found[f"r{i}"]).mean() == pytest.approx(-0.02 * np.sign(w), abs=2e-3)

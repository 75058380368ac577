"""Edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force where SQL is none."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import byte_bpe, chat, decontaminate, language_id, lm_scoring, ngram_join, pii, quality_rules, sharding, url_filter

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=60) for _ in range(12)]
    out = [None, "", " \n\t", "one", "one two three", "one two three", "a b c d e f", "A B C D E F", "x " * 30_000, "é" * 50_000]
    for b in base:
        out.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(60)] = rng.choice(words)
            out.append(" ".join(c))
    return [(i, t) for i, t in enumerate(out)] + [(20, out[20])]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_join_brute_force(spark, texts):
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        new = {i: min(label[j] for j in sets if i == j or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
        if new == label:
            break
        label = new
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(texts, DOCS)).collect()
    assert len(got) == len(texts) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}


def test_unlinked_near_copies_in_one_block(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(60):  # like the original, unlike each other
        c = list(base)
        for at in rng.sample(range(100), 3):
            c[at] = f"u{k}-{at}"
        rows.append((k + 1, " ".join(c)))
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame([*rows, (99, " ".join(base))], DOCS)).collect()
    sets = {i: shingles(t) for i, t in rows} | {99: shingles(" ".join(base))}
    linked = [i for i in sets if 100 * len(sets[i] & sets[99]) >= 80 * len(sets[i] | sets[99])]
    assert {r.component_id for r in got if r.doc_id in linked} == {min(linked)}


def test_large_classes_of_copies(spark, monkeypatch, texts):
    monkeypatch.setattr(ngram_join, "HOT", 5)
    base = texts[10][1]
    rows = [*texts, *((1000 + k, base) for k in range(40)), *((2000 + k, None) for k in range(20))]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    small = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(texts, DOCS)).collect()}
    own = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and all(own[k] == small[k] for k in small) and all(own[1000 + k] == small[10] for k in range(40)) and all(own[2000 + k] == 2000 + k for k in range(20))
    with pytest.raises(ValueError):
        ngram_join.ngram_jaccard_join(spark.createDataFrame(texts, DOCS), threshold=(1, 2))


def test_components_of_a_chain(spark):
    found = ngram_join.components(spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long"))
    assert {r.label for r in found.collect()} == {1}


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.org/es/x?q"), (4, "https://a.example.org/en/12#t"), (5, "http://badexample.org"), (6, "x://com/de/"), (7, "http://other.net/"), (7, "http://other.net/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.RULES).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5] == ("badexample.org", "", None, "allow") and got[6][2:] == ("com/de/", "block")


def test_a_host_of_many_labels_and_rules_of_different_length(spark):
    rules = {"org/": "allow", "a.b.example.org/x": "block", "example.org/": "block", "/": "block"}
    rows = [(1, "http://" + "a." * 100_000 + "org/x"), (2, "http://c.a.b.example.org/xy"), (3, "http://example.org"), (4, "http://" + "x" * 300_000 + "/"), (5, ""), (6, "http://b.example.org/x")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, "review").collect()}
    assert got == {1: ("org/", "allow"), 2: ("a.b.example.org/x", "block"), 3: (None, "review"), 4: (None, "review"), 5: (None, "review"), 6: ("example.org/", "block")}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_language(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    train = [(make("abcde"), "aa"), (make("vwxyz"), "zz"), (None, "aa"), ("abc", None)] * 5
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    mixed = make("abcde") + " " + make("vwxyz")
    got = language_id.predict(spark.createDataFrame([(1, make("abcde")), (2, make("vwxyz")), (3, None), (4, "123 !"), (5, "q"), (6, mixed)], DOCS), *model)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["aa", "zz", "und", "und"] and rows[5].lang_pred in ("aa", "zz")
    assert set(rows[6].mixture) == {"aa", "zz"} and all(0.4 < v < 0.6 for v in rows[6].mixture.values())
    assert language_id.predict(spark.createDataFrame([(1, "abc")], DOCS), [], np.zeros((0, language_id.TABLE), np.float32)).first().lang_pred == "und"


def plain_mixture(text, model):
    """The language and its share, step by step, from dicts of cell probabilities."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    cell = lambda i: (int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32 >> 16) & 65535
    n = Counter(cell(i) for i in range(len(raw) - 2))
    names = sorted(model)

    def em(some, steps):
        share = {k: 1 / len(some) for k in some}
        for _ in range(steps):
            new = dict.fromkeys(some, 0.0)
            for c, m in n.items():
                total = sum(share[k] * model[k][c] for k in some)
                for k in some:
                    new[k] += m * share[k] * model[k][c] / total
            share = {k: v / sum(new.values()) for k, v in new.items()}
        return share, sum(m * math.log(sum(share[k] * model[k][c] for k in some)) for c, m in n.items())

    single = {k: sum(m * math.log(model[k][c]) for c, m in n.items()) for k in names}
    best = max(names, key=lambda k: (single[k], -names.index(k)))
    rest, _ = em(names, 4)
    chosen, share, level = [best], {best: 1.0}, single[best]
    for k in sorted((k for k in names if k != best), key=lambda k: (-rest[k], names.index(k))):
        more, new = em([*chosen, k], language_id.STEPS)
        if new - level <= language_id.PENALTY * math.log(max(2, sum(n.values()))):
            break
        chosen, share, level = [*chosen, k], more, new
    return min(chosen, key=lambda k: (-share[k], names.index(k))), max(share.values())


def test_language_of_tiny_repeated_and_long_texts(spark):
    train = [("the cat and the dog " * 20, "en"), ("le chat et le chien " * 20, "fr")]
    model = language_id.train(spark.createDataFrame(train, "text string, lang string"))
    rows = [(1, "A."), (2, "q"), (3, "le chat"), (3, "le chat"), (4, "the dog and " * 200_000), (5, "é")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS mixture")
    got = language_id.predict(docs, *model).collect()
    by = {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 5)}
    assert by == {(1, "en", 0.5), (2, "en", 0.5), (5, "en", 0.5)} and all(r.mixture == {"en": 0.5, "fr": 0.5} for r in got if r.doc_id in (1, 2, 5))
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id in (3, 4)] == ["fr", "fr", "en"] and len(got) == 6 and all(0 <= r.score <= 1 for r in got)


def test_language_brute_force(spark):
    rng = random.Random(22)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghißé", "zz": "vwxyz"}
    make = lambda k, n=30: " ".join("".join(rng.choices(letters[k], k=rng.randrange(1, 7))) for _ in range(n))
    train = [(make(k), k) for k in letters for _ in range(6)] + [(None, "aa"), ("abc", None), ("", "bb")]
    counts = {k: Counter() for k in letters}
    for text, k in train:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()) if k else b""
        for i in range(len(raw) - 2):
            counts[k][(int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32 >> 16) & 65535] += 1
    model = {k: {c: (own[c] + 0.5) / (sum(own.values()) + 0.5 * 65536) for c in range(65536)} for k, own in counts.items()}
    docs = [(i, " ".join(make(rng.choice("aa bb cc zz".split()), 12) for _ in range(1 + i % 3)).title()) for i in range(24)]
    docs += [(100, "x" * 200_000 + make("aa")), (101, docs[3][1]), (101, docs[3][1])]
    got = language_id.predict(spark.createDataFrame(docs, DOCS), *language_id.train(spark.createDataFrame(train, "text string, lang string"))).collect()
    assert len(got) == len(docs)
    for r in got:
        lang, share = plain_mixture(dict(docs)[r.doc_id], model)
        assert r.lang_pred == lang and abs(r.score - min(1, share)) < 1e-4
    assert language_id.predict(spark.createDataFrame([], DOCS), ["aa"], np.zeros((1, language_id.TABLE), np.float32)).count() == 0


def hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, covered, listed = find(text), set(), set()
    for k, t in items:
        v = find(t)
        n = min(13, len(v))
        own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in own:
                covered |= set(range(i, i + n))
                listed.add(str(k))
    return len(w), len(covered), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest()


def test_decontamination_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)] + ["é", "ÉA"]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((30, 20, 13, 12, 3, 1, 14))] + [(90, ""), (91, None)]
    docs = [(1, None), (2, ""), (3, "w1"), (4, "x " * 5000)]
    for k in range(40):
        item = rng.choice(items[:7])[1].split()
        a = rng.randrange(len(item))
        docs.append((10 + k, " ".join([*rng.choices(words, k=rng.randrange(40)), *item[a : a + rng.randrange(30)], *rng.choices(words, k=20), *item]).title()))
    got = decontaminate.decontaminate(spark.createDataFrame([*docs, docs[-1]], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs) + 1
    want = {i: hits(t, items) for i, t in docs}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), empty).collect()} == {0}


def test_decontamination_of_very_many_hits(spark):
    items = [(1, "x"), (2, "x"), (3, "y z"), (None, "q")]
    docs = [(1, "x " * 400_000), (2, "y z " * 3), (3, "q q a"), (4, "X"), (5, None)]
    got = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (400_000, 400_000, 2, True) and (got[2].n_hit, got[2].n_items) == (6, 1)
    assert (got[3].n_hit, got[3].n_items, got[3].items_sha256) == (2, 0, hashlib.sha256(b"").hexdigest()) and got[4].n_items == 2 and not got[5].contaminated


@pytest.mark.parametrize("anchors", [0, decontaminate.MAX_ANCHORS])
def test_both_ways_to_find_short_items(spark, monkeypatch, anchors):
    monkeypatch.setattr(decontaminate, "MAX_ANCHORS", anchors)
    items, docs = [(k, f"w{k} w{k + 1}") for k in range(20)], [(k, f"a w{k} w{k + 1} w{k + 2} b") for k in range(25)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: hits(t, items) for i, t in docs}


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.public_vocabulary()
    tokens = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a" * 20_000), (4, "<|endoftext|>")] + [(k, "".join(rng.choices("abé 漢😀'st\n1|", k=200))) for k in range(5, 40)]
    for r in byte_bpe.encode(spark.createDataFrame(rows, DOCS), path, pattern).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    hashed = byte_bpe.PerfectHash(tokens[:1000])
    assert sorted(hashed.slots) == list(range(1000)) and all(hashed.rank(t) == k for k, t in enumerate(tokens[:1000])) and hashed.rank(b"\xff\xff\xff") == -1


@pytest.mark.parametrize("hot", [chat.HOT, 20])  # 20: blocks cut by turn, role and digest
def test_chats(spark, monkeypatch, hot):
    monkeypatch.setattr(chat, "HOT", hot)
    a, b = ("user", "hi"), ("assistant", "yo")
    logs = {1: [a], 2: [a, b], 3: [a, b, a], 4: [a, b, a], 5: [b], 6: [("user", None)] * 600, 7: [("user", None)] * 599}
    rows = [(c, i, *t) for c, turns in logs.items() for i, t in enumerate(turns)] + [(None, 0, "user", "lost"), (8, 0, "us<|er", "x<|end|>\n<|user|>\n<\\y")]
    rows += [(9, None, "user", f"t{k}") for k in range(300)] + [(10, None, "user", f"t{k}") for k in range(300)] + [(11, 5, None, "same")] * 300
    schema = "conv_id long, turn long, role string, text string"
    got = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert sorted({(r.conv_id, r.n_turns) for r in got}) == [(3, 3), (5, 1), (6, 600), (8, 1), (9, 300), (11, 300)]
    whole = {c: "".join(r.text for r in sorted(got, key=lambda r: r.part) if r.conv_id == c) for c in (5, 6, 8, 9, 11)}
    assert whole[5] == "<|assistant|>\nyo\n<|end|>\n" and whole[6].count("<|user|>") == 600 and whole[11].count("same") == 300
    assert whole[8].count("<|") == 2 and "x<\\|end|>" in whole[8] and "<\\\\y" in whole[8]
    order = sorted((f"t{k}" for k in range(300)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert re.findall(r"\|>\n(t\d+)\n", whole[9]) == order
    assert sorted(r.part for r in got if r.conv_id == 6) == list(range(sum(r.conv_id == 6 for r in got)))
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_personal_data(spark):
    text = "Mail a.b@c.de, ip 1.2.3.4 and 300.1.1.1; card 4111 1111 1111 1111, call +1 (234) 555-6789. @x.y a@b "
    kinds = [s[0] for s in pii.base_spans(text)]
    assert kinds == ["email", "ip", "card", "phone"]
    line = "{} {} zorblax {} to boss@corp.example {} {}"
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    docs = [(k, line.format(word(), word(), word(), word(), word())) for k in range(12)] + [(100 + k, "".join(f"the {word()} {word()} near to then met writes\n" for _ in range(20))) for k in range(90)] + [(200, None), (201, "")]
    rows = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")).collect()}
    assert "zorblax" not in rows[3] and "boss@" not in rows[3] and "[EMAIL]" in rows[3] and rows[200] is None and rows[201] == "" and rows[100] == dict(docs)[100]
    assert len(pii.base_spans("1" * 100_000 + "a" * 100_000 + "+1" + "(" * 50_000)) == 0


def test_signatures_disclose_and_near_copies_do_not(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    six, copied = ("zorblaxa", "quimbyer", "directrix", "logistica", "acmeworks", "springtown"), [word() for _ in range(60)]
    signed = [(k, f"{' '.join(word() for _ in range(k % 3 * 10))} {' '.join(six)} boss@corp.example {word()} {word()}") for k in range(6)]
    near = []
    for k in range(60):  # one line, copied with two other words in the rest
        c = list(copied)
        for at in rng.sample([*range(20), *range(40, 60)], 2):
            c[at] = word()
        near.append((100 + k, " ".join([*c[:30], "info@copy.example", *c[30:]])))
    other = [(1000 + k, "\n".join(" ".join(word() for _ in range(4)) for _ in range(40))) for k in range(60)]
    rows = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame([*signed, *near, *other], DOCS)).collect()}
    assert not any(t in rows[k] for k, _ in signed for t in six)
    assert all(rows[k] == text.replace("info@copy.example", "[EMAIL]") for k, text in near)


def test_quality(spark, texts):
    df = spark.createDataFrame(texts, DOCS)
    got = quality_rules.judge(df, report=True).collect()
    assert len(got) == len(texts) and all(r.base_failed for r in got if r.n_words < 20)
    names = [r.name for r in quality_rules.RULES]
    for order in (names, names[::-1]):
        assert {(r.doc_id, r.kept) for r in quality_rules.judge(df, order=order).collect()} == {(r.doc_id, r.kept) for r in got}
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_metrics_brute_force():
    rng = random.Random(21)
    pieces = ["- ", "•", "▪x", "*", "...", "…", "\n", " \n", "word ", "é ", "12 ", "| ", "\t", ". . .", "◦ a"]
    texts = ["", "\n", *("".join(rng.choices(pieces, k=rng.randrange(25))) for _ in range(500))]
    data = "".join(texts).encode()
    t = quality_rules.Texts(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts)]))
    lines = [[x for x in text.split("\n") if x.strip(" \t\n\v\f\r")] for text in texts]
    assert t.get("n_text_lines").tolist() == [len(x) for x in lines]
    assert t.get("n_bullet_lines").tolist() == [sum(x.strip(" \t")[0] in "-*•‣▪●◦" for x in own) for own in lines]
    assert t.get("n_ellipsis_lines").tolist() == [sum(x.rstrip(" \t").endswith(("...", "…")) for x in own) for own in lines]
    assert t.get("n_letter_words").tolist() == [sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", x)) for x in texts]


def test_scores(spark):
    good, bad = "the cat sat on the mat " * 20, "zq xv kj " * 40
    docs = spark.createDataFrame([(1, good), (2, bad), (3, None), (4, ""), (5, good)], DOCS)
    rows = {r.doc_id: r for r in lm_scoring.score(docs, spark.createDataFrame([(1,), (1,)], "doc_id long")).collect()}
    assert rows[1].score < 0 < rows[2].score and rows[3].score is None and rows[4].n_tokens == 0 and rows[5].score == rows[1].score


def word_losses(docs, good, s=lm_scoring.SMOOTHING):
    """Mean losses by a model of all words and pairs, straight from the definition."""
    texts = [(i, (t or "").split()) for i, t in docs]
    model = {}
    for name, own in (("good", [w for i, w in texts if i in good]), ("all", [w for _, w in texts])):
        model[name] = Counter(x for w in own for x in w), Counter(x for w in own for x in zip([None, *w], w)), sum(map(len, own)), sum(bool(w) for w in own)
    scale, vocabulary = max(1, model["good"][2]) / max(1, model["all"][2]), max(1, len(model["all"][0]))

    def loss(w, name, k):
        one, two, n, texts_ = model[name]
        out = 0
        for v, x in zip([None, *w], w):
            p = (one[x] * k + s / vocabulary) / (n * k + s)
            out -= math.log((two[v, x] * k + s * p) / ((texts_ if v is None else one[v]) * k + s))
        return out / len(w)

    return sorted((i, len(w), *((loss(w, "good", 1), loss(w, "all", scale)) if w else (-1, -1))) for i, w in texts)


@pytest.mark.parametrize("frequent, labels", [(3, 0), (60, lm_scoring.LABELS), (20_000, lm_scoring.LABELS)])  # no, some and all words known to every task
def test_word_scores_brute_force(spark, monkeypatch, frequent, labels):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "LABELS", labels)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(("the", "of", *(f"w{rng.randrange(300)}" for _ in range(6))), k=rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "of"), (4, docs[4][1]), (4, "the the the"), *((300 + k, docs[0][1]) for k in range(40))]
    good = set(range(0, 120, 3)) | {203}
    got = lm_scoring.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()
    rows = sorted((r.doc_id, r.n_tokens, -1 if r.loss_target is None else r.loss_target, -1 if r.loss_background is None else r.loss_background) for r in got)
    assert np.allclose(rows, word_losses(docs, good))


def test_scores_tell_phrases_of_equal_spelling_apart(spark):
    rng = random.Random(9)
    make = lambda own: " ".join(rng.choices(own, k=60))
    names = ["".join(rng.choices("abc", k=6)) for _ in range(80)]
    docs = [(i, make(names[:40] if i % 2 else names[40:])) for i in range(80)]
    rows = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i,) for i in range(1, 80, 2)], "doc_id long")).collect()}
    assert all(rows[i] < 0 if i % 2 else rows[i] > 3 for i in range(80))


def test_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(2000)] + [(7, "x" * 2), (None, None)], DOCS)
    rows = sharding.shard(docs, [1.0] * 8).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and len(rows) == 2002
    heavy = [r.shard for r in sharding.shard(docs, [3.0, 1.0]).collect()]
    assert 0.7 < heavy.count(0) / len(heavy) < 0.8


CLASH = "doc_id long, text string, text_hash string, _id int, _hash int, kept string, rejected_by string, row int, n int, label int"


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    make = lambda: " ".join(rng.choices(words, k=60))
    same, item = make(), " ".join(rng.choices(words, k=40))
    rows = [(i, t, "a", 1, 2, "c", "d", 3, 4, 5) for i, t in [(1, make()), (2, same), (3, same), (4, item), (5, make()), (5, make()), (None, make()), (None, make()), (6, None), (7, "")]]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, CLASH)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before
    got = docs.collect()
    fives = [r for r in rows if r[0] == 5]
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 2, 5] and all(tuple(r)[2:] == rows[0][2:] for r in got)
    assert next(r.text for r in got if r.doc_id == 5) == min(r[1] for r in fives)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_personal_data_of_many_entities_on_one_line():
    text = "name x@y.zz " * 20_000
    spans = pii.base_spans(text)
    assert len(spans) == 20_000 and len([x for x in pii._evidence(text) if x[3] is None]) == 40_000
    assert len(pii.all_spans(text, {"name": (0.6, "email")})) == 40_000
    test = pii._outside([("a", 3, 5), ("b", 4, 9), ("c", 12, 14)])
    text = "abcdefghijklmnop"
    want = {(s, e): not any(a < e and s < b for a, b in ((3, 5), (4, 9), (12, 14))) for s in range(15) for e in range(s + 1, 16)}
    assert {k: test(re.compile(".{%d}" % (k[1] - k[0])).match(text, k[0])) for k in want} == want


def plain_spans(text):
    """The contract's patterns as they stand, with their conditions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_brute_force(spark):
    rng = random.Random(12)
    pieces = ["a.b", "@", "x-y", ".", "com", "1", "25", "255", "300", "0007", "4111111111111111", " ", "-", "+1", "(", ")", "é", "Ⅷ", "\n", "+44 20 7946 0958", "4111-1111 1111-1111"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(4000)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts) and sum(len(pii.base_spans(t)) for t in texts) > 2000
    rows = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:500])] + [(-1, None)], DOCS)).collect()
    assert len(rows) == 501 and all([tuple(s) for s in r.spans if s.kind != "term"] == plain_spans(texts[r.doc_id] if r.doc_id >= 0 else "") for r in rows)


def plain_disclosure(texts):
    """n(e), n(t), n(e, t) over distinct lines, by nested loops; no near copies in the input."""
    lines = [x for t in texts for x in t.split("\n")]
    word = lambda x: re.findall(r"[^\W\d_]{3,}", x)
    joint, own = {}, {}
    for line in set(lines):
        spans = plain_spans(line)
        cut = [m for m in re.finditer(r"[^\W\d_]{3,}", line) if not any(m.start() < e and s < m.end() for _, s, e in spans)]
        for kind, s, e in spans:
            key = kind, re.sub(r"[^0-9.]", "", line[s:e]) if kind != "email" else line[s:e].lower()
            own.setdefault(key, set()).add(line)
            for m in [m for m in cut if m.end() <= s][-8:] + [m for m in cut if m.start() >= e][:8]:
                joint.setdefault((key, m[0].lower()), set()).add(line)
    n = Counter(t for line in set(lines) for t in {x.lower() for x in word(line)})
    ok = {}
    for (key, t), at in joint.items():
        p = len(at) / n[t]
        if len(at) >= pii.SUPPORT and p >= pii.GENERALISE and math.log2(len(lines) * len(at) / (len(own[key]) * n[t])) >= pii.BITS:
            ok[t] = max(ok.get(t, (0, "")), (p, ""))
    return {t: round(p, 9) for t, (p, _) in ok.items()}


@pytest.mark.parametrize("limit", [0, pii.MAX_TERM_BYTES])  # terms joined by key, and sent to every task
def test_disclosure_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "MAX_TERM_BYTES", limit)
    rng = random.Random(13)
    word = lambda k=3: "".join(rng.choices("abcdeé", k=k))
    names = ["zorblⅧx", "quimby", "Ümlaut"] + ["".join(rng.choices("mnop", k=6)) for _ in range(25)]
    texts = [None, "", "e" * 330 + " a@b.cc"]
    for k in range(300):
        i = rng.randrange(len(names))
        name, e = names[i], rng.choice(["a@b.cc", "1.2.3.4", "x@y.zz", "+44 20 7946 0958"]) if rng.random() < 0.2 else f"own{i}@b.cc"
        texts.append("\n".join(f"{k}{j} {' '.join(word() for _ in range(3))} {'#' * 400} " + (f"{name} {e} {word()}" if rng.random() < 0.2 else rng.choice([name, word()]) * (rng.random() < 0.1)) for j in range(6)))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.term: round(r.p, 9) for r in pii.disclosing_terms(df).collect()}
    assert got == plain_disclosure([t for t in texts if t is not None]) and got
    few = pii.find(df).collect()
    assert any(s.kind == "term" for r in few for s in r.spans)
    terms = {s for r in few for s in ((texts[r.doc_id] or "")[x.start : x.end].lower() for x in r.spans if x.kind == "term")}
    assert terms == set(got) or terms < set(got)


def plain_quality(text):
    """Whether a text passes, straight from the rules."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    n, chars = len(w), sum(map(len, w))
    return not (
        n < 20 or 100 * len(repeated) > 30 * n or chars > 15 * n or 10 * chars < 15 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * n or 2 * (len(lines) - len({*lines})) > text.count("\n") + 1
        or 10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 3 * n or 10 * sum(x.strip()[0] in "-*•‣▪●◦" for x in lines) > 9 * len(lines) or 10 * sum(x.rstrip().endswith(("...", "…")) for x in lines) > 3 * len(lines)
        or 10 * sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w) < 6 * n
    )


def plain_clean(text, terms):
    """The text with base spans and disclosing terms (p and kind) replaced."""
    base = plain_spans(text)
    spans = base + [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in terms and not any(m.start() < e and s < m.end() for _, s, e in base)]
    out, at = "", 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            p, of = terms.get(text[s:e].lower(), (0, ""))
            out += text[at:s] + (f"[{kind.upper()}]" if kind != "term" else "" if p >= pii.REMOVE else f"[{of.upper()} TERM]")
        at = max(at, e)
    return out + text[at:]


def test_pipeline_brute_force(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import corpus_pipeline

    rng = random.Random(23)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mé", "ni") for b in ("ra", "tu", "vo", "sch") for c in ("s", "n", "kt", "")]
    make = lambda n=60: "\n".join(" ".join(rng.choices(vocabulary, k=10)) for _ in range(n // 10))
    items = [(k, make(30)) for k in range(4)]
    docs = [(k, make(rng.choice((10, 40, 90)))) for k in range(150)] + [(200 + k, f"{make(30)}\n{make(10)} zorblax boss@corp.example {k} quimby\n{make(20)}") for k in range(6)]
    docs += [(300, docs[3][1]), (301, docs[3][1].upper()), (302, docs[4][1] + " tail"), (303, make(40) + "\n" + items[1][1]), (304, "spam " * 50), (305, None), (306, ""), (307, "call +1 (234) 555-6789 now\n" + make(40))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [(i, t) for i, t in docs if plain_quality(t)]
    sets, label = {i: shingles(t) for i, t in kept}, {i: i for i, _ in kept}
    linked = {i: [j for j in sets if i == j or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in sets}
    for _ in range(9):
        label = {i: min(label[j] for j in linked[i]) for i in sets}
    kept = [(i, t) for i, t in kept if label[i] == i]
    judged = {i: hits(t, items) for i, t in kept}
    kept = [(i, t) for i, t in kept if not (judged[i][1] > 0 and 20 * judged[i][1] >= judged[i][0])]
    shares = plain_disclosure([t for _, t in kept])
    assert {"zorblax", "quimby"} <= set(shares)
    kinds = {r.term: r.kind for r in pii.disclosing_terms(spark.createDataFrame(kept, DOCS)).collect()}
    path, pattern = byte_bpe.public_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(byte_bpe.read_ranks(path))}, special_tokens={})
    assert set(got) == {i for i, _ in kept} and len(got) < len(docs) - 10
    for i, t in kept:
        text = plain_clean(t, {k: (p, kinds[k]) for k, p in shares.items()})
        assert bytes(got[i].decoded).decode() == text and np.frombuffer(got[i].ids, "<u4").tolist() == known.encode_ordinary(text)

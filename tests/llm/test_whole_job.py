"""Places where an operator once did less than its whole job."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from loomwork.llm import mixing, neardup, pii, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


# --- near copies in the pipeline


def edited(words, *places):
    return " ".join(f"other{i}" if i in places else w for i, w in enumerate(words))


def test_pipeline_drops_near_copies_from_080(spark):
    rows = []
    for g in range(30):  # two edits in 120 words: 106 of 126 shingles, 0.841
        words = [f"g{g}w{i}" for i in range(120)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, edited(words, 30, 80)), (10 * g + 2, edited(words, *range(5, 120, 11)))]
    docs = documents(spark, rows)
    left = Counter(r.doc_id % 10 for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert left == {0: 30, 2: 30}
    assert sum(r.kept for r in neardup.near_duplicates(docs).collect()) == 90  # op9 keeps its 0.85


def test_pipeline_judges_each_text_of_a_doc_id(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(3, " ".join(words)), (5, edited(words, 60)), (5, "a text of its own that stays"), (None, edited(words, 7)), (None, "another text of its own that stays"), (None, None), (None, None)]
    rows += [(7, " ".join(f"v{i}" for i in range(120))), (7, edited([f"v{i}" for i in range(120)], 60))]  # near copies under one doc_id
    out = Counter((r.doc_id, (r.text or "")[:12]) for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect())
    assert sum(out.values()) == 5, out
    assert {(3, "w0 w1 w2 w3 "), (5, "a text of it"), (None, "another text"), (None, ""), (7, "v0 v1 v2 v3 ")} <= set(out)


@pytest.mark.parametrize("link", [(80, 100), (85, 100), (90, 100)])
def test_bands_follow_the_threshold(link):
    plan = neardup.plan_of(link)
    s = link[0] / link[1]
    assert (1 - s**plan.rows) ** plan.bands < 4e-7 and plan.bands * plan.rows % 2 == 0
    rng = np.random.default_rng(1)
    assert (rng.binomial(plan.bands * plan.rows, s, 100_000) >= plan.floor).all()


# --- personal data: terms of entities that stand in one text or two


def test_pii_terms_of_one_text(spark):
    plain = [(100 + i, f"This is Note number {i} about plain things, with words like all the others. Please write soon.") for i in range(1200)]
    rows = [(1, "Please write soon to Zebedee Quillfeather about plain things with words like all the others and more such words, at z.q@mail.example.org. This is Note number"), (2, "The others know Quillfeather")]
    rows += [(3, "Call Ng at +44 20 7946 0958 soon. This is plain.")] * 40
    out = {r.doc_id: r for r in pii.sanitise(documents(spark, plain + rows), with_text=True).collect()}
    assert "Zebedee" not in out[1].clean_text and "Quillfeather" not in out[1].clean_text and "[TERM]" in out[1].clean_text
    assert "Quillfeather" not in out[2].clean_text and "Ng" not in out[3].clean_text.split()
    assert all(out[100 + i].n_terms == 0 for i in range(1200))


def test_pii_copies_are_one_text(spark):
    rows = [(i, "Write to Kingfisher at k.f@mail.example.org now") for i in range(50)] + [(100 + i, f"now write to note {i}") for i in range(200)]
    got = {r.term: r for r in pii.disclosures(pii.base_spans(documents(spark, rows))).collect()}
    assert got["kingfisher"].together == got["kingfisher"].term_rows == got["kingfisher"].entity_rows == 1
    assert pii.GENERALISE <= got["kingfisher"].disclosure < pii.REMOVE


# --- secrets: random letters


@pytest.mark.parametrize("key", ["xkqjzvbnwpqlmzxkvbtr", "QWZXKJHVBNMPLTRSDF", "83920-x7461-29q38-47561"])
def test_random_letters_and_figures_are_found(key):
    base, more = secrets.scan(f"the key {key} is here", secrets_path(), 2.2, 16)
    assert not base and more == [(8, 8 + len(key))]


def test_words_numbers_and_digests_are_left(spark):
    text = "internationalization_of_organizations getElementByIdentifier 4111-1111-1111-1111 2026-01-01T10-30-00Z Rechtsschutzversicherungsgesellschaften"
    assert secrets.scan(text, secrets_path(), 2.2, 16) == ([], [])


def secrets_path():
    import public_tokenizers as tok

    return tok.path(secrets.VOCABULARY)


# --- mixing: a rare cell doesn't thin out all others


def test_mixing_keeps_a_share_of_tokens_whatever_is_rare(spark):
    rows = [(i, f"a b c d {i}", "en", f"s{i % 4}", 1) for i in range(4000)] + [(9000, "a b c d e", None, "odd", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, share=0.9).collect()
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.copies * r.n_tokens for r in out) == pytest.approx(0.9 * tokens, rel=0.05)
    assert sum(r.selected for r in out) > 0.8 * len(out) > sum(r.selected for r in mixing.mix(docs).collect())
    rare = next(r for r in out if r.doc_id == 9000)
    assert rare.copies >= 2 and rare.probability == 1
    assert sum(r.doc_id == 9000 for r in mixing.drawn(docs, share=0.9).collect()) == rare.copies


def plain_disclosures(texts, least):
    """Degrees by plain loops over the distinct texts: the terms near an entity are 8 words on either side, and up to 24 in
    its sentence."""
    border = lambda w: not w[0].isalpha()
    texts = sorted(set(texts))
    near, entities, rows = defaultdict(lambda: defaultdict(bool)), defaultdict(set), defaultdict(set)
    for k, text in enumerate(texts):
        found = [(m.start(), f"0:{m.group().lower()}", None) for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        tokens = [(m.start(), None, m.group()) for m in regex.finditer(f"{pii.TERM}|{pii.BORDER}", text)]
        for _, _, w in tokens:
            if not border(w):
                rows[w.lower()].add(k)
        every = sorted(found + tokens, key=lambda x: x[0])
        for i, (_, e, _) in enumerate(every):
            if e is None:
                continue
            entities[e].add(k)
            for side in (range(i - 1, max(i - 25, -1), -1), range(i + 1, min(i + 25, len(every)))):
                ended = False
                for n, j in enumerate(side):
                    word = every[j][2]
                    if word is not None and border(word):
                        ended = True
                    elif word is not None and (n < 8 or not ended):
                        as_name = word[0].isupper() and j > 0 and not (every[j - 1][2] and border(every[j - 1][2]))
                        near[e, word.lower()][k] |= as_name
    out = {}
    for (e, term), uses in near.items():
        m, names = len(entities[e]), sum(uses.values())
        c = len(uses) if len(uses) >= 3 else (names - 0.5) * names / m
        if c > 0 and m < len(texts):
            degree = math.log(len(texts) * c / (m * len(rows[term]))) / math.log(len(texts) / m)
            if degree >= least:
                out[e, term] = round(degree, 9)
    return out


def test_disclosures_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    words = ["plain", "Words", "about", "Things", "other", "more", "Kim", "Ann.", "such", "else!", "Note", "and\n", "Quill", "then"]
    texts = []
    for i in range(260):
        some = [str(rng.choice(words)) for _ in range(int(rng.integers(5, 60)))]
        for _ in range(int(rng.integers(0, 3)) if i % 2 else 0):
            some.insert(int(rng.integers(0, len(some))), f"u{rng.integers(0, 40)}@mail.example.org")
        if i % 5 == 1:
            some.insert(int(rng.integers(0, len(some))), f"Rare{chr(97 + i % 26)}{chr(97 + i // 26)}")
        texts.append(" ".join(some))
    texts += texts[:40]
    got = {(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosures(pii.base_spans(documents(spark, list(enumerate(texts)))), least=0.1).collect()}
    assert got == plain_disclosures(texts, 0.1) and len(got) > 5


def test_planted_names_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(4, 8))))  # noqa: E731  most are rare
    rows, names = [], set()
    for i in range(600):
        said = [word() for _ in range(20)]
        if i % 10 == 0:
            name = word().capitalize() + "son"
            names.add(name.lower())
            said[5:5] = [name, f"at {word()}{i}@mail.example.org"]
        rows.append((i, " ".join(said)))
    found = {r.term for r in pii.disclosures(pii.base_spans(documents(spark, rows))).select("term").collect()}
    assert found == names  # precision and recall 1


def test_long_text_of_entries_is_no_square(spark):
    text = "".join(f"Nam{chr(97 + i % 26)}{chr(97 + i // 26)} | user{i}@mail{i}.example.org | " for i in range(600))
    began = time.time()
    (r,) = pii.sanitise(documents(spark, [(1, text)])).collect()
    small = time.time() - began
    began = time.time()
    (big,) = pii.sanitise(documents(spark, [(1, text * 10)])).collect()
    assert r.n_email == 600 and big.n_email == 6000 and time.time() - began < small + 12

"""Operators 4, 5 and 7: held-out accuracy, base spans, given and mined rules."""

from __future__ import annotations

import collections
import re

from pyspark.sql import functions as F

from pulseboard.llm import lang_id, pii, url_rules
from pulseboard.llm.queries import URL_RULES, op4_lang_id
from tests.conftest import SF01
from tests.llm import cases


def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = op4_lang_id(spark, SF01).join(truth, "doc_id").where("held_out")
    n, right, low, high = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert n > 200 and right / n > 0.95 and 0 <= low <= high <= 1


def test_language_edge_cases(docs, no_docs):
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.lang_pred, r.score) for r in lang_id.identify(docs, model).collect()}
    und = {r[0] for r in got if r[1] == lang_id.UND}
    assert {4, 5, 6, 9, None} <= und and all(s == 0 for _, p, s in got if p == lang_id.UND)
    assert not und & {0, 10, 17, 18}
    nothing = lang_id.fit(no_docs)
    assert {r.lang_pred for r in lang_id.identify(docs, nothing).collect()} == {lang_id.UND}
    assert lang_id.identify(no_docs, model).count() == 0


def test_letters_of_every_plane():
    """Only letters make a text more than ``und``; every code point counts as Python says."""
    table = lang_id._letter_table()
    assert len(table) == 0x110000 and all(table[c] == chr(c).isalpha() for c in range(0, 0x110000, 7))
    for text, has in (("𝄞 𝟘𝟙", False), ("\U0010fffd \U000f0000", False), ("𝔄", True), ("\U00020000", True), ("😀 🏳", False), ("12 ½ _", False), ("ª", True)):
        assert (len(lang_id.gram_counts(text)[0]) > 0) == has


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGUAGES", 3)
    rows = [(k, cases.prose(k, 8), f"l{min(k % 40, 4 + k % 2)}") for k in range(400)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["l0", "l4", "l5"]
    assert len(model.languages) == model.weights.shape[1]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
            if [True, kind == 1 and all(int(x) < 256 for x in m.group().split(".")), 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    texts = [r[1] for r in cases.documents()] + [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()]
    texts += ["a@b@c.de.f @x.y a@.b", "1.2.3.4.5.6.7.8 01.002.3.0255", "12-34 5678  9012-3456-7890", "+1+22333444555 +1 ( ) . -", "é+49 (0)30 123456-7 ü@x.y"]
    for t in texts:
        if t:
            assert pii.base_spans(t, pii.base_matches(t)) == brute_base(t)


def test_pieces_of_failed_matches_are_added(spark, no_docs):
    source = spark.read.parquet(f"{SF01}/documents.parquet")
    model = pii.fit(source)
    assert model.trees is not None
    text = "Call +1 (499) 555-6503 10.1.2.3 today"
    base, every = model.spans(text)
    assert [text[a:b] for a, _, b in base] == ["10.1.2.3"]
    assert [text[a:b] for a, _, b in every] == ["+1 (499) 555-6503", "10.1.2.3"]
    assert pii.redacted(text, every) == "Call [PHONE] [IP] today"
    clean = "Version 2.0.1 of 2024-01-31, page 12 of 345, item 1234567, 3.14 and (a)."
    assert model.spans(clean) == ([], []) and model.spans(None) == ([], [])
    assert pii.fit(no_docs).trees is None and pii.find_personal(no_docs, model).count() == 0


def test_phone_pieces_are_proposed_however_far_they_reach():
    """The pieces of a failed match are its starts of 9 to 15 digits; separators between them do not count."""
    text = "+1" + "." * 300 + "(499) 555-6503 10.1.2.3"
    base, others = pii.proposals(text)
    assert base == [(len(text) - 8, 1, len(text))]
    end = text.index("6503") + 4
    assert (0, 3, end) in others and pii.valid(3, text[:end])
    digits = lambda s: sum(c.isdigit() for c in text[s[0] : s[2]])
    assert sorted(digits(s) for s in others if s[:2] == (0, 3)) == [11, 13, 14, 15, 16]


def test_rows_and_nulls_of_personal_data(docs):
    got = pii.find_personal(docs, pii.fit(docs)).collect()
    assert len(got) == len(cases.documents())
    for r in got:
        if r.doc_id in (4, 5, 6):
            assert r.base == [] and r.redacted == {4: None, 5: "", 6: " \n\t"}[r.doc_id]


def test_personal_data_is_learnt_from_every_text(spark, monkeypatch):
    """All labelled candidates of all texts are counted, of long texts and of many texts (F2)."""
    texts = [f"mail a{k}@b{k}.example or 10.0.{k % 300}.{k % 7} or +49 30 {100000 + k}" for k in range(4000)]
    texts += [" ".join(f"u{k}@example.com 999.1.2.{k}" for k in range(200)), None, "", "no number"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    want = collections.Counter((kind, y, tuple(x)) for t in texts if t for x, y, kind in zip(*pii.labelled(t)))
    for most in (pii.COUNTED, 10):
        monkeypatch.setattr(pii, "COUNTED", most)
        got = collections.Counter()
        for r in pii.counted(df).collect():
            got[r.kind, r.y, tuple(r.x)] += r.n
        assert got == want
    assert sum(want.values()) > 3 * 4000 and max(len(pii.labelled(t)[1]) for t in texts if t) >= 400
    assert pii.fit(df).trees is not None


def test_urls(spark):
    pages = [
        (1, "https://www.Example.com/en/x?q#f", "h"), (2, "http://m.example.com/en/", "h"), (3, "http://example.com", "h"),
        (4, "ftp://a.net/es/1", "h"), (5, "http://net/fr/", "h"), (6, "http://xnet/fr/", "h"), (7, None, "h"), (8, "no scheme/en/", "h"),
        (8, "http://x.org:80/de/?a=/en/", "h"), (9, "://", "h"), (None, "http://EXAMPLE.com/EN/", "h"), (10, "http://com#x/", "h"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, labels, URL_RULES).collect()}
    assert got[1, pages[0][1]] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2, pages[1][1]] == ("m.example.com", "/en/", "example.com/en/", "block")
    assert got[3, pages[2][1]] == ("example.com", "", None, "allow")
    assert got[4, pages[3][1]][2:] == ("net/es/", "block") and got[5, pages[4][1]][2:] == ("net/fr/", "block")
    assert got[6, pages[5][1]][2:] == (None, "allow") and got[7, None] == ("", "", None, "allow")
    assert got[8, "no scheme/en/"] == ("", "", None, "allow") and got[8, pages[8][1]] == ("x.org:80", "/de/", None, "allow")
    assert got[9, "://"] == ("", "", None, "allow") and got[None, pages[10][1]] == ("example.com", "/EN/", "com/", "allow")
    assert got[10, pages[11][1]] == ("com", "", None, "allow")
    assert url_rules.judge(df.limit(0), labels, URL_RULES).count() == 0
    assert url_rules.judge(df, labels.limit(0), URL_RULES).count() == len(pages)


def test_mined_rules_equal_counted_ones(spark):
    """Pages with both ``win`` and ``spin`` are bad; either word alone is not."""
    urls = [(k, f"http://a{k % 7}.org/{'win/' if k % 2 else ''}{'spin/' if k % 3 == 0 else ''}{k}") for k in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if k % 6 == 3 else 1, 0) for k in range(240)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels, support=0.05, confidence=0.9)
    assert {frozenset(r["items"]) for r in rules.collect()} >= {frozenset(["win", "spin"])}
    split = {k: set(re.findall("[a-z0-9-]+", re.sub(r"/[0-9]+", "/0", u))) for k, u in urls}
    for r in rules.collect():
        fits = [k for k in range(240) if set(r["items"]) <= split[k]]
        assert len(fits) >= 20 and r.confidence >= 0.9 and abs(r.confidence - sum(k % 6 == 3 for k in fits) / len(fits)) < 1e-9
    hit = {r.url for r in url_rules.matched(pages, rules).collect()}
    assert hit == {u for k, u in urls if any(set(r["items"]) <= split[k] for r in rules.collect())}
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, []).collect()}
    assert all((verdicts[k] == "block") == (k % 6 == 3) for k in range(300))

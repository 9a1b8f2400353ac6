"""Language ID, URL reputation and decontamination."""

import hashlib
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as E
from convolens.llm import language_id
from convolens.llm.decontaminate import contamination, hit_spans, uncontaminated
from convolens.llm.url_reputation import host_of, judge_urls, judged_by_rules, path_of, reputations, suffix_rules, with_levels

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in E.queries()["op3_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) > 0.97, right / len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, score int, rejected string"
    en, es = "the cat sat on the mat and then it went home to sleep ", "el gato se sentó en la alfombra y luego fue a dormir "
    train = [(i, en * (i % 3 + 1) + str(i), "en", 1, "") for i in range(6)] + [(9 + i, es + str(i), "es", 1, "") for i in range(6)]
    model = language_id.fit(spark.createDataFrame([*train, (50, None, "xx", 0, ""), (51, "abc", None, 0, "")], schema))
    assert set(model) == {"en", "es"}
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, en * 4000), (5, es), (5, es), (None, en)]
    df = spark.createDataFrame([(d, t, "zz", 0, "") for d, t in rows], schema)
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(df, model, 0.01).collect()), key=repr)
    want = [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (5, "es", False), (5, "es", False), (None, "en", False)]
    assert got == sorted(want, key=repr)
    assert {r.lang_pred for r in language_id.predict(df, {}).collect()} == {"und"}
    empty = spark.createDataFrame([], schema)
    assert language_id.fit(empty) == {} and language_id.predict(empty, model).count() == 0
    kept = language_id.accepted(df, model, 0.01)
    assert kept.schema == df.schema and sorted_rows(kept.select("doc_id")) == [(4,), (5,), (5,), (None,)]
    assert language_id.accepted(empty, model, 0.01).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(train, schema), languages=1)


def labelled_documents(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    return [d for d in docs if d[1]], "doc_id long, text string, lang string"


def test_rejection_of_unlearned_and_mixed_languages(spark):
    rows, schema = labelled_documents(spark)
    known = spark.createDataFrame([r for r in rows if r[2] != "fr"], schema)
    words, held = language_id.learning(known)
    model = language_id.fit(words)
    margins = language_id.fit_margins(held, model)
    assert margins and all(0 <= m < 0.3 for m in margins.values())
    long = [r for r in rows if len(r[1]) > 300]
    rejected = lambda texts: [
        r.rejected for r in language_id.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model, margins).collect()
    ]
    unlearned = rejected([t for _, t, la in long if la == "fr"])
    clean = rejected([t for _, t, la in long if la != "fr"])
    german, spanish = ([t for _, t, la in long if la == x] for x in ("de", "es"))
    def halves(n, a=german, b=spanish):  # as many letters of either, in turns
        return " ".join(x for k in range(0, 300, 60) for x in (a[n % len(a)][k : k + 60], b[n % len(b)][k : k + 60]))
    mixed = rejected([halves(n) for n in range(60)])
    share = lambda xs: sum(xs) / len(xs)
    print("rejected: unlearned", share(unlearned), "mixed", share(mixed), "known", share(clean))
    assert share(unlearned) > 0.9 and share(clean) < 0.02 and share(mixed) > 3 * share(clean)
    # without margins nothing of that is caught
    bare = language_id.predict(spark.createDataFrame([(1, t) for _, t, la in long if la == "fr"], "doc_id long, text string"), model)
    assert not any(r.rejected for r in bare.collect())


def test_the_choice_is_the_smallest_total(spark):
    """Brute force: every block against every dictionary, compressed here."""
    import zstandard

    rows, schema = labelled_documents(spark)
    model = language_id.fit(spark.createDataFrame(rows, schema))
    some = rows[:120] + [(-1, "x" * 30_000 + " the house", "en"), (-2, "the " + "la " * 20_000, "es")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(some, schema), model).collect()}
    for doc, text, _ in some:
        letters = re.sub(r"[\W\d_]+", " ", text.lower())
        totals = {}
        for lang, content in model.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                9, source_size=language_id.BLOCK, dict_size=len(content), write_content_size=False, write_dict_id=False)
            press = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
            totals[lang] = sum(len(press.compress(letters[i : i + 8192].encode())) for i in range(0, len(letters), 8192))
        least = min(totals.values())
        assert got[doc].lang_pred == min(la for la, n in totals.items() if n == least), doc  # ties: the first by name
        second = sorted(totals.values())[1]
        assert abs(got[doc].score - (1 - least / second)) < 1e-12


def test_margins_by_length():
    margins = {4: 0.5, 8: 0.2, 9: 0.0}
    at = lambda n: language_id.margin_for(margins, n)
    assert [at(1), at(15), at(40), at(200), at(300), at(10**6)] == [0.5, 0.5, 0.5, 0.2, 0.0, 0.0]
    assert language_id.margin_for(0.3, 5) == 0.3 and language_id.margin_for({}, 5) == 0.0


def brute_op7(docs, items, span=10):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n, table in windows.items():
            for k in range(len(w) - n + 1):
                own = table.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_op7(docs, items)
    assert sorted_rows(E.queries()["op7_decontamination"](spark, SF)) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_a_benchmark_item_of_six_megabytes_is_joined(spark, monkeypatch):
    """One long item, passages of it in documents, and a passage that most documents share."""
    item = " ".join(f"w{(i * i) % 99_991}x{i % 7}" for i in range(640_000))
    assert len(item) > 5_500_000
    at = lambda k, n: " ".join(item.split(" ")[k : k + n])
    hot = at(300_000, 25)
    docs = [(i, f"own words {i} before {hot} and after {i}") for i in range(300)] + [
        (1_000, at(5, 12)), (1_001, at(639_980, 20)), (1_002, at(7, 9)), (1_003, at(100, 30) + " x " + at(50, 11)), (1_004, None), (1_005, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([("long", item), ("short", "own words 7"), ("twice", hot)], "item_id string, text string")
    got = {r.doc_id: r for r in hit_spans(d, b).collect()}
    assert [tuple(s) for s in got[5].spans] == [(4, 29)] and list(got[5]["items"]) == ["long", "twice"]
    assert [tuple(s) for s in got[7].spans] == [(0, 3), (4, 29)] and list(got[7]["items"]) == ["long", "short", "twice"]
    assert [tuple(s) for s in got[1_000].spans] == [(0, 12)] and [tuple(s) for s in got[1_001].spans] == [(0, 20)]
    assert not got[1_002].spans and not got[1_005].spans and got[1_004].n_words == 0
    assert [tuple(s) for s in got[1_003].spans] == [(0, 30), (31, 42)] and len(got) == len(docs)
    assert sorted(r.doc_id for r in uncontaminated(d, b).collect()) == [1_002, 1_004, 1_005]


@pytest.mark.parametrize("most", [100_000, 0])  # sent to the tasks; joined
def test_decontamination_cases(spark, most):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (10, "Short Item"), (2, "a b c d e f"), (2, "same id again x"), (None, "no id here"), (3, None), (4, ""), (5, "..."), (6, "zé 日本"), (7, long)]
    part = " ".join(f"w{i}" for i in range(20, 30))
    docs = [
        (1, long), (2, f"x {part} y"), (3, "w20 w21 w22 w23 w24 w25 w26 w27 w28"), (4, None), (5, ""), (6, "the short-item here"),
        (7, "A,B;C d e f g a b c d e"), (8, "zé 日本 no id here"), (8, f"{part} {part}"), (None, part.upper()), (9, "w " * 30_000 + part), (11, "..."),
    ]
    schema = "doc_id long, text string, spans string, items string, n_words int"
    d = spark.createDataFrame([(*r, "", "", 1) for r in docs], schema)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = contamination(hit_spans(d, b, broadcast_windows=most))
    assert sorted_rows(got) == brute_op7(docs, items)
    clean = uncontaminated(d, b, broadcast_windows=most)
    assert clean.schema == d.schema
    assert sorted_rows(clean.select("doc_id")) == sorted(((r[0],) for r in brute_op7(docs, items) if not r[5]), key=repr)
    assert uncontaminated(d, b.limit(0)).count() == len(docs) and uncontaminated(d.limit(0), b).count() == 0
    assert sorted_rows(contamination(hit_spans(d, b.limit(0)))) == brute_op7(docs, [])
    assert hit_spans(d.limit(0), b).count() == 0


def test_url_parts(spark):
    cases = {
        "https://A.Example.com/En/x?y#z": ("a.example.com", "/En/x"), "http://h": ("h", ""), "http://h?q=/a": ("h", ""),
        "http://h/a://b/c": ("h", "/a://b/c"), "no scheme/x": ("", ""), "": ("", ""), None: ("", ""), "://É.COM/x\ny": ("É.com", "/x\ny"),
        "ftp://u@h:80#f/g": ("u@h:80", ""),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", host_of(df.url).alias("h"), path_of(df.url).alias("p")).collect()}
    assert got == cases


def test_domains_by_a_suffix_list(spark):
    listed = suffix_rules(spark, ["com", "co.nz", "com.cn", "*.ck", "!www.ck", "blogspot.com", "CO.UK ", "co.nz"])
    want = {
        "a.b.example.com": ("example.com", "com"), "x.co.nz": ("x.co.nz", "co.nz"), "y.x.co.nz": ("x.co.nz", "co.nz"),
        "a.com.cn": ("a.com.cn", "com.cn"), "com.cn": ("com.cn", "com.cn"), "s.other.ck": ("s.other.ck", "other.ck"),
        "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "me.blogspot.com": ("me.blogspot.com", "blogspot.com"),
        "shop.co.uk": ("shop.co.uk", "co.uk"), "u@h.example.org:8080": ("example.org", "org"), "localhost": ("localhost", "localhost"),
        "10.0.0.1": ("10.0.0.1", "ip"), "10.0.0.2:80": ("10.0.0.2", "ip"), "[::1]:443": ("[::1]", "ip"), "": ("", ""),
    }
    hosts = spark.createDataFrame([(h, 1) for h in want], "host string, n int")
    got = {r.host: (r.domain, r.suffix) for r in with_levels(hosts, listed).collect()}
    assert got == want
    none = with_levels(hosts, listed.limit(0))
    assert {r.host: r.domain for r in none.collect()}["x.co.nz"] == "co.nz"  # no list: the last label is the suffix
    assert with_levels(hosts.limit(0), listed).count() == 0


def test_equally_long_rules_and_a_long_url(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("allow", "b.a.com", "/"), ("block", "a.com", "/xy/")]
    long = "http://b.a.com/" + "z/" * 100_000 + "?" + "q" * 100_000
    df = spark.createDataFrame([(1, "http://a.com/x1"), (2, "http://b.a.com/xy/"), (3, long)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {1: ("a.com/x", "block"), 2: ("a.com/xy/", "block"), 3: ("b.a.com/", "allow")}


def test_rules_and_reputation(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    rows = [
        (1, "http://a.example.com/en/1", "example.com/en/", "block"), (2, "http://www.example.com/en/", "www.example.com/en/", "allow"),
        (3, "http://a.www.example.com/en/", "www.example.com/en/", "allow"), (4, "http://xexample.com/en/", "com/", "allow"),
        (5, "http://com", None, None), (6, "http://com/", "com/", "allow"), (7, None, None, None), (8, "http://h.net/es/", "net/es/", "block"),
        (8, "http://h.net/es/", "net/es/", "block"), (None, "http://h.net/", None, None),
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in rows], "page_id long, url string, host string, rule string")
    got = judged_by_rules(df, rules).select("page_id", "rule", "rule_verdict")
    assert sorted_rows(got) == sorted(((i, r, v) for i, _, r, v in rows), key=repr)
    out = judge_urls(df, rules)
    assert out.count() == len(rows) and out.filter("verdict is null").count() == 0
    assert judge_urls(df.limit(0), rules).count() == 0

    outcomes = [("bad.x.org", 1)] * 40 + [("good.y.org", 0)] * 40 + [("new.x.org", None), ("new.y.org", None), ("z.org", 1)]
    rep = {r.host: r for r in reputations(spark.createDataFrame(outcomes, "host string, outcome int")).collect()}
    assert rep["bad.x.org"].rate > rep["new.x.org"].rate > rep["new.y.org"].rate > rep["good.y.org"].rate
    assert rep["z.org"].deviation > rep["bad.x.org"].deviation and rep["new.x.org"].labelled == 0


def test_url_query_matches_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    rel = con.execute(E.oracle_sql()["op5_url_reputation"])
    names = [d[0] for d in rel.description]
    df = E.queries()["op5_url_reputation"](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.select(*names)) == sorted(map(tuple, rel.fetchall()), key=repr)

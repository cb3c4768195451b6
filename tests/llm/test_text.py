import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.llm import chunk_dedup as c
from tallyard.llm import html_text as h
from tallyard.llm import quality_rules as q
from tallyard.llm import toxicity as tx


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, at = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at.update(p + k for p in places for k in range(3))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(at)


def test_base_counts(docs, rows):
    got = {r["doc_id"]: r for r in q.quality_rules(docs, None).collect()}
    for r in rows:
        base, g = brute_base(r[1] or ""), got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == base
        assert g["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and g["kept"] != g["base_failed"]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    field = q.Field(rng.normal(size=(q.WIDTH, 2)), rng.normal(size=(2, 2)), 0.5)
    for _ in range(30):
        lines = [sorted(rng.choice(q.WIDTH, 4, replace=False).tolist()) for _ in range(rng.integers(1, 8))]
        score = lambda ys: sum(field.emit[on, y].sum() for on, y in zip(lines, ys)) + sum(field.move[a, b] for a, b in zip(ys, ys[1:]))
        best = max(score([k >> i & 1 for i in range(len(lines))]) for k in range(2 ** len(lines)))
        assert abs(score(field.lines(lines)) - best) < 1e-9


def test_field_learns_and_keeps_clean_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = q.fit_field(d, labels)
    out = q.quality_rules(d, field).join(labels, "doc_id").filter("not base_failed")
    right = out.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    kept = q.keep_quality(d, field)
    assert kept.columns == d.columns and kept.count() == q.quality_rules(d, field).filter("kept").count()


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        score, move = rng.normal(size=(1, n, 2)), rng.normal(size=(2, 2))
        one, both = q.chain_marginals(score, move, np.ones((1, n), bool))
        ways = {ys: np.exp(sum(score[0, t, y] for t, y in enumerate(ys)) + sum(move[a, b] for a, b in zip(ys, ys[1:]))) for ys in itertools.product((0, 1), repeat=n)}
        total = sum(ways.values())
        for t in range(n):
            assert abs(one[0, t, 1] - sum(w for ys, w in ways.items() if ys[t]) / total) < 1e-9
        for t in range(n - 1):
            assert abs(both[0, t, 1, 0] - sum(w for ys, w in ways.items() if ys[t] and not ys[t + 1]) / total) < 1e-9


def test_labels_change_inside_composed_texts(spark):
    """Boilerplate lines of bad documents are found where they stand among the lines of good ones, and the other way round."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = q.fit_field(d, labels)
    rows = d.join(labels, "doc_id").filter("text is not null").orderBy("doc_id").select("text", "quality").collect()
    good = [[x for x in r["text"].split("\n") if x.split()] for r in rows if r["quality"]]
    junk = [x for r in rows if not r["quality"] for x in r["text"].split("\n") if x.count(" | ") > 3 or x.count("%%%") > 3]
    rng = np.random.default_rng(1)
    right = marked = put = 0
    for lines in good[:120]:
        at = sorted(rng.choice(len(lines) + 1, min(2, len(lines)), replace=False).tolist(), reverse=True)
        gold = [0] * len(lines)
        lines = lines[:]
        for k in at:
            lines.insert(k, junk[rng.integers(len(junk))])
            gold.insert(k, 1)
        text = "\n".join(lines).encode()
        found = field.lines(q.text_features(text)[0])
        right += sum(a and b for a, b in zip(found, gold))
        marked, put = marked + sum(found), put + sum(gold)
        assert 0 < field.content_share(text) < 1
    assert len(junk) > 20 and right > 0.9 * marked and right > 0.9 * put
    shares = {r[0] for r in q.quality_rules(d, field).select("content_share").collect()}
    assert any(0 < s < 1 for s in shares)


def test_lines_of_a_sample_are_latent():
    """A good document keeps a boilerplate line as such, and a bad one a content line."""
    plain, bars = [0, 3], [0, 2]
    windows = [[plain] * 6, [plain] * 5 + [bars]] * 20 + [[bars] * 6, [bars] * 5 + [plain]] * 20
    found = q.line_labels(windows, [0] * 40 + [1] * 40)
    assert found[1] == [0] * 5 + [1] and found[-1] == [1] * 5 + [0] and found[0] == [0] * 6


def test_quality_edge_cases(docs, empty, labels):
    assert q.fit_field(empty, labels.limit(0)) is None
    assert q.quality_rules(empty, None).count() == 0 and q.keep_quality(empty, None).columns == empty.columns
    assert q.keep_quality(docs, None).columns == docs.columns


def test_toxicity_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = tx.toxicity(d, tx.fit_grammar(d, labels))
    assert out.count() == d.count() and out.filter("score < 0 or score > 1 or score is null").count() == 0
    held = out.filter("held_out").join(labels, "doc_id").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert held[0] > 0.85 and held[1] < 0.01


def test_toxicity_edge_cases(docs, empty, labels):
    g = tx.fit_grammar(docs, labels)
    assert tx.toxicity(docs, g).count() == docs.count() and tx.toxicity(empty, g).count() == 0
    assert tx.fit_grammar(empty, labels.limit(0)).words


def test_each_transducer_changes_the_score():
    """Kinds of clauses, best paths and their order of scores."""
    g = tx.Grammar({"idiot": 1.0}, {"vequ": 1.0})
    used = lambda text: dict(zip((*tx.FEATURES, "clauses"), g.clauses(text, {})))
    on = lambda text: {k for k, v in used(text).items() if v} - {"clauses"}
    assert on("An idiot walks.") == {"insult"} and on("You idiot!") == on("idiot, you") == {"insult", "addressed insult"}
    assert on("You see a tree and a cloud and an idiot") == {"insult"}
    assert on("He is not an idiot.") == {"insult", "negated"} and on("not one two three four idiot") == {"insult"}
    assert on("She said he is an idiot.") == on("idiot, he said") == {"insult", "reported"} and on("she said. idiot") == {"insult"}
    assert on("I will kill you") == {"threat", "addressed threat"} and on("they kill time") == {"threat"} and on("vequmo la.") == {"insult"}
    assert used("you idiot, idiot. A vequmo! said nothing") == {"insult": 3, "threat": 0, "addressed insult": 2, "addressed threat": 0, "negated": 0, "reported": 0, "clauses": 2}
    assert not on("you and not said. nothing here") and not on("")
    score = lambda text: g.score(g.clauses(text, {}))
    for weak, strong in (("", "a idiot"), ("not idiot", "a idiot"), ("said idiot", "a idiot"), ("a idiot", "you idiot"), ("a kill", "you kill"), ("said not idiot", "said idiot"), ("", "not idiot")):
        assert score(weak) < score(strong)


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(8)
    g = tx.Grammar({}, {}, np.array([-4.0, 2.5, 3.0, 1.0, 1.5, -2.0, -1.5]))
    gain = dict(enumerate(g.weights[1:]))

    def paths(state, clause):
        if not clause:
            if tx.AUTOMATON.accepts(state):
                yield ()
            return
        for symbol in clause[0]:
            for _, features, after in tx.AUTOMATON.arcs.get(state, {}).get(symbol, ()):
                for rest in paths(after, clause[1:]):
                    yield features + rest

    weight = lambda used: sum(gain[f] for f in used)
    for _ in range(150):
        clause = tuple(rng.choice(["W", "I", "T", "Y", "N", "R", "IY", "W"]) for _ in range(rng.integers(1, 8)))
        best = max(map(weight, paths(0, clause)))
        got = g.best_path(clause)
        assert abs(sum(n * gain[f] for f, n in enumerate(got)) - best) < 1e-9


def test_composition_is_the_cascade():
    """The composed automaton and its parts, run one after the other, read random clauses alike."""
    marked = [h + a for h in tx.HITS for a in ("", "-")]
    quoted = [h + a for h in marked for a in ("", '"')]
    parts = [tx.negation(), tx.reported(marked), tx.target(quoted)]
    whole = tx.compose(tx.compose(parts[0], parts[1]), parts[2])

    def runs(t, symbols):
        front = {(0, ())}
        for x in symbols:
            front = {(after, (*out, o)) for state, out in front for o, _, after in t.arcs.get(state, {}).get(x, ())}
        return {out for state, out in front if t.accepts(state)}

    rng = np.random.default_rng(9)
    for _ in range(100):
        clause = tuple(rng.choice(["W", "I", "T", "Y", "N", "R"], rng.integers(1, 7)))
        step = {clause}
        for t in parts:
            step = set().union(*(runs(t, x) for x in step))
        assert runs(whole, clause) == step


def test_chunks_resist_insertions():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a = {text[s:e] for s, e in zip([0, *c.chunk_ends(text)], c.chunk_ends(text))}
    other = text[:7000] + b"INSERTED" + text[7000:]
    b = {other[s:e] for s, e in zip([0, *c.chunk_ends(other)], c.chunk_ends(other))}
    assert len(a - b) <= 4 and len(a) > 200
    ends = c.chunk_ends(text)
    assert ends[-1] == len(text) and all(1 <= y - x <= c.MOST for x, y in zip(ends[:-2], ends[1:-1]))
    bound = lambda t: {t[x:y] for x, y in zip(*c.chunk_bounds(t))}
    whole, moved = bound(text), bound(other)
    assert len(whole - moved) <= 12 and len(whole) > 500 and len({len(x) for x in whole}) > 20
    assert all(c.LEAST <= len(x) < c.LEAST + c.MOST for x in whole)


def test_gear_window():
    data = np.frombuffer(b"abc" * 40, np.uint8)
    h = c.gear_hashes(data)
    for i in (0, 5, 31, 32, 119):
        want = sum(int(c.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % 2**32
        assert int(h[i]) == want


def test_repeats_in_one_document_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))
    s, u, p = prose(90), prose(90), prose(70)
    four = " ".join([prose(20), p, prose(30), p, prose(20), p, p])
    rows = [(1, s, "x"), (2, s, "x"), (2, u, "y"), (2, u, "y"), (3, four, "z"), (4, "a" * 1000, "z"), (5, None, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string")
    spans = c.repeated_spans(d).collect()
    by_doc = {k: [r for r in spans if r["doc_id"] == k] for k in range(1, 6)}
    assert not by_doc[1] and not by_doc[5] and len(by_doc[2]) == 1 and by_doc[2][0]["end"] > len(s) - 80
    covered = sum(r["end"] - r["start"] for r in by_doc[3])
    assert 3 * (len(p) - 130) < covered <= 3 * (len(p) + 2) and all(r["first_doc_ids"] == [3] for r in by_doc[3])
    assert [(r["start"] >= c.LEAST, 1000 - c.MOST <= r["end"] <= 1000) for r in by_doc[4]] == [(True, True)]
    cut = c.without_spans(d, c.repeated_spans(d))
    assert cut.columns == d.columns
    texts = sorted((r["doc_id"], r["text"]) for r in cut.collect() if r["text"] is not None)
    assert [t for k, t in texts if k == 2].count(u) == 2 and (1, s) in texts and any(k == 2 and len(t) < 160 for k, t in texts)


def test_passages_are_caught_and_clean_documents_left(spark, empty):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(n))
    passage = prose(70)
    rows = [(k, prose(int(rng.integers(5, 60))) + " " + (passage + " " if k % 3 == 0 else "") + prose(80)) for k in range(60)]
    d = spark.createDataFrame([*rows, (100, None), (101, ""), (None, passage)], "doc_id long, text string")
    spans = c.repeated_spans(d)
    assert {r["doc_id"] for r in spans.collect()} == {k for k in range(3, 60, 3)}
    assert all(0 in r["first_doc_ids"] for r in spans.collect())
    cut = {r["doc_id"]: r["text"] for r in c.without_spans(d, spans).collect()}
    assert all(cut[k] == t for k, t in rows if k % 3) and all(len(cut[k]) < len(t) - 250 for k, t in rows if k and not k % 3) and cut[100] is None
    assert c.repeated_spans(empty).count() == 0


@pytest.mark.parametrize("letters", [3, 4, 5])
def test_passages_of_51_short_words_are_caught_at_every_offset(spark, letters):
    rng = np.random.default_rng(letters)
    prose = lambda n, k=4: " ".join("".join(rng.choice(list("abcdefghijkl"), k)) for _ in range(n))
    passages, rows = [prose(51, letters) for _ in range(100)], []
    for k, passage in enumerate(passages):
        for _ in range(2):
            rows.append((len(rows), prose(30)[: int(rng.integers(150))] + "|" + passage + "|" + prose(40)))
    rows += [(len(rows) + k, "twin " + "xyz"[k % 3] * 12 + "a" * 80) for k in range(6)]
    spans = c.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in spans} == {*range(1, 200, 2), 203, 204, 205}
    text = {k: t.encode() for k, t in rows}
    for r in spans:
        lot, owners = text[r["doc_id"]], [text[o] for o in r["first_doc_ids"]]
        assert all(any(lot[a : a + c.LEAST] in o for o in owners) for a in range(r["start"], r["end"] - c.LEAST + 1))


def test_spans_against_all_substrings(spark):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdéß"), rng.integers(1, 6))) for _ in range(n))
    passages = [prose(n) for n in (20, 40, 55, 70, 120)]
    rows = [(k * 7 % 60, prose(int(rng.integers(0, 40))).join(passages[i] for i in rng.integers(0, 5, rng.integers(1, 4)))) for k in range(60)]
    spans = c.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {k: t.encode() for k, t in rows}
    size = 22 + 2 * c.MOST + c.LEAST
    assert size == 191
    first: dict[bytes, int] = {}
    for k in sorted(text):
        covered = np.zeros(len(text[k]) + 1, int)
        for r in spans:
            if r["doc_id"] == k:
                covered[r["start"] + 1 : r["end"] + 1] = 1
                # Each covered byte lies in LEAST bytes that stand in an owner too.
                owned = np.zeros(len(text[k]), bool)
                for a in range(len(text[k]) - c.LEAST + 1):
                    part = text[k][a : a + c.LEAST]
                    if any((part in text[o]) if o != k else (text[k].find(part) < a) for o in r["first_doc_ids"]):
                        owned[a : a + c.LEAST] = True
                assert owned[r["start"] : r["end"]].all()
        total = np.cumsum(covered)
        for a in range(len(text[k]) - size + 1):
            if first.setdefault(text[k][a : a + size], k) < k:
                assert total[a + size] - total[a] >= c.LEAST
    assert sum(r["doc_id"] > 0 for r in spans) > 30


def test_html_layout():
    page = "<title>no</title><h1>Head</h1><p>One <b>bold</b>,\n two<p>three<br>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><caption>Cap<tr><th>Name<th>N<tr><td>ab<td>1</table><pre>  a\n   b</pre><div hidden>no</div><div style='display: none'>no</div><script>no</script>tail &amp; end"
    assert h.html_to_text(page) == "Head\n\nOne bold, two\n\nthree\nfour\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nCap\nName  N\nab    1\n\n  a\n   b\n\ntail & end"


def test_tables_keep_their_order_and_stray_text():
    page = "<table>stray<thead><tr><th>A<th>Bee<tbody><tr><td>1<td>2<tr><td colspan=2>wide<tfoot><tr><td>x<td><table><tr><td>in</table></table>end"
    assert h.html_to_text(page) == "stray\nA     Bee\n1     2\nwide\nx     in\n\nend"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a</b></i>b", "ab"), ("</td><td>x", "x"), ("<div>" * 5000 + "deep", "deep"), ("<ul><li>", "-"), ("<table></table>x", "x")])
def test_html_edge_cases(page, text):
    assert h.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8><body><p>a<div>b</div>", "a\n\nb"),
    ("<html><head><title>t</title><link rel=x><script>s</script><p>a", "a"),
    ("<head><style>s</style>a<b>b</b>", "ab"),
    ("<p>a<head><title>t</title></head>b", "ab"),
])
def test_head_needs_no_end_tag(page, text):
    assert h.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("a<textarea>\nb  c\nd</textarea>e", "a b  c\nd e"),
    ("in <select><option>a<option selected>b  c<option>d</select>end", "in b c end"),
    ("in <select><option disabled>a<optgroup label=g><option>b</select>end", "in b end"),
    ("in <select multiple><option>a<optgroup label=g><option label=l>b</optgroup></select>end", "in\na\ng\nl\nend"),
    ("<svg><title>t</title><defs><text>d</text></defs><path d='M0'/><g><text>a <tspan>b</tspan></text></g>x<text>c</text></svg>end", "a b c end"),
    ("<svg><defs/><text>a</text><foreignObject><p>b</p></foreignObject></svg>", "a\n\nb"),
    ("<svg><path><p>a<svg/>b", "ab"),
    ("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>tex</annotation></semantics></math> is", "x=1 is"),
])
def test_controls_and_drawings_show_their_text(page, text):
    assert h.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>", "aa  b\n    c\nd   e"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b    c\nd       e\nf  g"),
    ("<table><thead><tr><th rowspan=9>h<th>i<tbody><tr><td>a<td>b</table>", "h  i\na  b"),
])
def test_cells_that_span_rows(page, text):
    assert h.html_to_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<div>" * 300 + "<div hidden>secret</div><p style='display:none'>x<b>y</b></p>seen" + "</div>" * 300 + "<p>end", "seen\n\nend"),
    ("<div>" * 300 + "a<br>b<div hidden>" + "<div>" * 300 + "secret", "a\nb"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<ul><li>no</ul></div>end", "yes\n\nend"),
    ("<style>.x, p.y {display: none} /* .z{display:none} */ #i{visibility:hidden} @media print{.z{display:none}}</style><p class='a x'>no<p class=y>no</p><b id=i>no</b><i class=y>yes</i><b class=z> z</b>", "yes z"),
    ("a<noscript>b</noscript><object>c</object><iframe>d</iframe>", "abc"),
    ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes<tr><td>a<td>b</table>", "   yes\na  b"),
    ("<table><tr><td colspan=150>a<td>b</table>", "a" + "  " * 150 + "b"),
])
def test_visibility_rules(page, text):
    assert h.html_to_text(page) == text


def test_long_lines_take_linear_time(spark):
    import time

    taken = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert len(h.html_to_text("<p>" + "<b>word</b> " * n)) == 5 * n - 1
        taken.append(time.process_time() - began)
    assert taken[1] < 8 * taken[0]


def test_page_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old", 7), (1, "<p>a", "old", 7), (None, None, None, None)], "page_id long, html string, text string, keep int")
    out = h.extract_pages(pages)
    assert out.columns == ["page_id", "html", "keep", "text"] and sorted(r["text"] for r in out.collect()) == ["", "a", "a"]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = h.extract_pages(pages)
    assert out.columns == ["page_id", "url", "html", "text"] and out.count() == pages.count()
    for r in out.limit(20).collect():
        shown = re.sub(r"<(script|style|title)[^>]*>.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", r["html"], flags=re.S)
        import html as std

        words = std.unescape(re.sub(r"<[^>]+>", " ", shown)).split()
        assert re.findall(r"\S+", re.sub(r"^\s*- ", "", r["text"], flags=re.M).replace("\n- ", "\n")) == words
    assert h.extract_pages(pages.limit(0)).count() == 0

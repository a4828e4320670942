from pyspark.sql import functions as F

from wardline.llm import lines
from wardline.llm.lines import Settings


def brute(rows, ratio, least):
    """Texts without boilerplate, for (host, text) rows."""
    shown = lambda t: [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\f")]
    totals, counts = {}, {}
    for host, text in rows:
        totals[host] = totals.get(host, 0) + 1
        for line in set(shown(text)):
            counts[host, line] = counts.get((host, line), 0) + 1
    out = []
    for host, text in rows:
        gone = lambda x: counts[host, x] >= least and counts[host, x] / totals[host] > ratio  # noqa: E731, B023
        kept = [x for x in (text or "").split("\n") if not x.strip(" \t\n\r\x0b\f") or not gone(x)]
        out.append("\n".join(kept) if any(x.strip(" \t\n\r\x0b\f") for x in kept) and text is not None else text)
    return out


def rows_of(spark):
    texts = ["head\nown %d\nfoot", "head\n\nown %d\n\nother %d", "head\nfoot", "foot", None, "", "\n\n", "own\nown\nhead"]
    rows = [(i, h, texts[i % len(texts)].replace("%d", str(i)) if texts[i % len(texts)] is not None else None) for i in range(60) for h in ("a", "b", None)[: 1 + i % 3]]
    return rows, spark.createDataFrame(rows, "page_id long, host string, text string")


def test_equals_brute_force_both_ways(spark):
    rows, frame = rows_of(spark)
    expected = brute([(h, t) for _, h, t in rows], 0.3, 3)
    for small_table in (1000, 0):
        result = lines.drop_boilerplate(frame, F.col("host"), "text", Settings(0.3, 3), small_table=small_table)
        found = {(r.page_id, r.host): r.text for r in result.collect()}
        assert [found[i, h] for i, h, _ in rows] == expected
    assert any(e != t for e, (_, _, t) in zip(expected, rows))


def test_a_page_of_boilerplate_alone_keeps_its_text(spark):
    frame = spark.createDataFrame([(i, "h", "same\nlines") for i in range(10)], "page_id long, host string, text string")
    assert {r.text for r in lines.drop_boilerplate(frame, F.col("host"), "text").collect()} == {"same\nlines"}


def test_shown_text_and_hosts(spark):
    html = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><!-- x\ny --><p>a  b<br>c</p><B>d</B>'
    row = spark.createDataFrame([(html, "HTTPS://u@A.example.org:80/x?y")], "h string, u string").select(
        lines.page_text(F.col("h")).alias("t"), lines.host_of(F.col("u")).alias("u"), lines.host_of(F.lit("no url")).alias("n")
    ).first()
    assert row.t.strip().split("\n") == ["T", "a b", "c", "d"] and row.u == "a.example.org" and row.n is None


def test_odd_rows(odd, nothing):
    result = lines.drop_boilerplate(odd, F.col("source"), "text")
    assert result.columns == odd.columns and result.count() == 10
    assert {r.doc_id: r.text for r in result.collect()}[4] is None
    assert lines.drop_boilerplate(nothing, F.col("source"), "text").count() == 0


def test_no_python_in_the_plan(spark):
    plan = lines.drop_boilerplate(rows_of(spark)[1], F.col("host"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_passages_of_a_large_source_are_found(spark):
    """Planted on 3 of 600 documents: a passage of 60 words goes, a line of 9 words stays; on 55 of 600 the line goes too."""
    prose = lambda seed, size: " ".join(f"w{seed}x{k}" for k in range(size))
    passage, rare, common, twice = prose("p", 60), prose("r", 9), prose("c", 9), prose("t", 60)
    rows = []
    for i in range(600):
        planted = [line for line, among in ((passage, i < 3), (rare, i < 3), (common, i < 55), (twice, i < 2)) if among]
        rows.append((i, [f"{prose(i, 100)}", *planted, prose(f"{i}e", 100)], planted))
    frame = spark.createDataFrame([(i, "s", "\n".join(t)) for i, t, _ in rows], "doc_id long, source string, text string")
    for small_table in (1000, 0):
        settings = Settings(long_words=50, max_lost=0.5)
        found = {r.doc_id: r.text for r in lines.drop_boilerplate(frame, F.col("source"), "text", settings, small_table=small_table).collect()}
        assert found == {i: "\n".join(x for x in t if x not in (passage, common)) for i, t, _ in rows}


def test_a_long_list_is_looked_up_in_slots(spark):
    """200 passages to drop in one source, 13 slots; and a null host with a list of its own."""
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(50))
    own = lambda i: " ".join(f"o{i}w{j}" for j in range(300))
    rows = [(i, None if i % 4 == 3 else "s", "\n".join([own(i), *(line(k) for k in range(i // 4 % 50, 200, 50))])) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = lines.drop_boilerplate(frame, F.col("source"), "text", Settings(long_words=50)).collect()
    assert {r.doc_id: r.text for r in found} == {i: own(i) for i, _, _ in rows}


def test_frames_go_and_near_copies_stay(spark):
    """Two frame lines on all pages of a host go though they are most of a page; copies on a third of a host keep their text."""
    prose = lambda seed, size: " ".join(f"w{seed}x{k}" for k in range(size))
    head, foot = prose("h", 30), prose("f", 30)
    framed = [(i, f"{head}\n{prose(i, 20)}\n{foot}", "framed") for i in range(100)]
    shared = "\n".join(prose(f"s{k}", 60) for k in range(8))
    copies = [(200 + i, f"{shared}\nedit {i}", "copied") for i in range(20)]
    others = [(300 + i, prose(f"o{i}", 80) + "\n" + prose(f"p{i}", 80), "copied") for i in range(40)]
    frame = spark.createDataFrame(framed + copies + others, "doc_id long, text string, source string")
    settings = Settings(long_words=50, max_lost=0.5)
    for small_table in (1000, 0):
        found = lines.drop_boilerplate(frame, F.col("source"), "text", settings, small_table=small_table)
        expected = {i: prose(i, 20) for i in range(100)} | {i: t for i, t, _ in copies + others}
        assert {r.doc_id: r.text for r in found.collect()} == expected


def test_hot_lines_and_repeated_rows_in_the_large_form(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_LINE", 5)
    rows, frame = rows_of(spark)
    frame, rows = frame.union(frame), rows + rows
    expected = brute([(h, t) for _, h, t in rows], 0.3, 3)
    result = lines.drop_boilerplate(frame, F.col("host"), "text", Settings(0.3, 3), small_table=0)
    order = lambda found: sorted(found, key=str)
    assert order((r.page_id, r.host, r.text) for r in result.collect()) == order((i, h, e) for (i, h, _), e in zip(rows, expected))


def test_a_page_of_very_many_lines(spark):
    """40,000 lines, half of them on all pages of the host; lists in slots, distinct lines by hashing."""
    pages = [(i, "h", "\n".join(f"shared {k}" if k % 2 else f"own {i} {k}" for k in range(40_000))) for i in range(3)]
    frame = spark.createDataFrame(pages, "page_id long, host string, text string")
    expected = {i: "\n".join(f"own {i} {k}" for k in range(0, 40_000, 2)) for i in range(3)}
    for small_table in (100_000, 0):
        found = lines.drop_boilerplate(frame, F.col("host"), "text", small_table=small_table).collect()
        assert {r.page_id: r.text for r in found} == expected

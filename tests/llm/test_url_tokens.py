"""URLs are judged by all of their tokens."""

from lectern.llm import url_filters


def test_urls_are_judged_by_all_their_tokens(spark):
    known = [(i, f"https://h{i % 7}.net/es/a{i}/b{i}/c{i}/promo.zip") for i in range(40)] + [(100 + i, f"https://h{i % 7}.com/a{i}/b{i}/c{i}/d{i}/story.html") for i in range(40)]
    asked = [(900, "https://q.org/1/2/3/4/promo"), (901, "https://q.org/1/2/3/4/x.zip"), (902, "https://q.org/1/2/3/4/story"), (903, "https://q.org/1/2/3/4/other")]
    rows = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(known + asked, "page_id long, url string")).collect()}
    assert [rows[k]["verdict"] for k, _ in asked] == ["block", "block", "allow", "allow"]
    assert [rows[k]["confidence"] for k, _ in asked][:3] == [1.0, 1.0, 1.0]


def test_every_token_of_a_url(spark):
    url = "http://a.b.c.d.e/p1/p2/p3/p4/p5.HTML?q1=1&q2=2&q3=3&q4=4"
    frame = spark.createDataFrame([(url,)], "url string").withColumns(dict(zip(("host", "path"), url_filters.host_and_path(url_filters.F.col("url")), strict=True)))
    (row,) = frame.select(url_filters.tokens(*(url_filters.F.col(c) for c in frame.columns)).alias("t")).collect()
    want = {f"domain={x}" for x in ("e", "d.e", "c.d.e", "b.c.d.e", "a.b.c.d.e")} | {f"path=p{i}" for i in range(1, 6)} | {"path=html", "type=html"} | {f"query=q{i}" for i in range(1, 5)}
    assert set(row["t"]) == want | {"scheme=http", "label=a"} and len(row["t"]) == len(set(row["t"]))

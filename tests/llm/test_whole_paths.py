"""Templates of deep paths."""

from atlasloom.llm.url_filter import url_filter


def test_deep_segments_are_told_apart(spark):
    rows, labels = [], []
    for i in range(200):
        kind = "spam" if i % 2 else "news"
        rows.append((i, f"https://h/a/b/c/d/e/{kind}/{i}"))
        labels.append((i, kind == "spam"))
    rows.append((200, "https://h/x"))
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert len(got) == 201
    assert {got[i].verdict for i in range(1, 200, 2)} == {"block"} and {got[i].verdict for i in range(0, 200, 2)} == {"allow"}
    assert {got[i].template.split("/")[-2] for i in range(0, 200, 2)} == {"news"}
    assert {len(r.template.split("/")) for k, r in got.items() if k < 200} == {8}

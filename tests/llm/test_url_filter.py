from plumbline.llm import url_filter as u

CASES = {
    "http://a.example.org/en/15?x": ("a.example.org", "/en/15", "example.org/en/1", "block"), "https://EXAMPLE.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
    "http://org/": ("org", "/", "org/", "allow"), "http://xorg/": ("xorg", "/", None, "allow"), "http://a.com/de/1": ("a.com", "/de/1", "com/de/", "block"),
    "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"), "http://a.com": ("a.com", "", None, "allow"), "http://a.org": ("a.org", "", None, "allow"),
    "http://a.org#/x": ("a.org", "", None, "allow"), "a.org/x": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    "x://y://z.org/": ("y:", "//z.org/", None, "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://É.org/es/#": ("É.org", "/es/", "org/", "allow"), "http://" + "a." * 3000 + "com/de/" + "x" * 5000: ("a." * 3000 + "com", "/de/" + "x" * 5000, "com/de/", "block"),
}


def test_verdicts(spark):
    pages = spark.createDataFrame([(i % 4 if i % 5 else None, url, "h") for i, url in enumerate(CASES)] * 2, "page_id long, url string, host string").repartition(3)
    found = u.judge(pages, u.rules_frame(spark))
    rows = found.collect()
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, [(r.host, r.path, r.rule, r.verdict) for r in rows])) == sorted(map(str, [*CASES.values()] * 2))


def test_precedence_and_other_rules(spark):
    rules = u.rules_frame(spark, ["block b.c/x", "allow c/x/yz", "block d", "allow e/", "block e/"])
    pages = spark.createDataFrame([(1, "h://a.b.c/x/yz"), (2, "h://c/x/yz"), (3, "h://z.d/q"), (4, "h://e/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, rules, default="block").collect()}
    assert found == {1: ("c/x/yz", "allow"), 2: ("c/x/yz", "allow"), 3: ("d", "block"), 4: ("e/", "block")}
    assert {r.verdict for r in u.judge(pages, u.rules_frame(spark).limit(0)).collect()} == {"allow"}
    assert u.judge(pages.limit(0), rules).count() == 0

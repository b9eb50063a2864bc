"""Social links against values worked out by hand."""

from pyspark.sql import functions as F

from webgrain.functions import social


def parsed(spark, cell, name="Acme Tools", site="https://www.acme.com/x"):
    df = spark.createDataFrame([(cell, name, site)], "c string, n string, w string")
    links = social.parse_links(F.col("c"), social.brand_tokens(F.col("n"), F.col("w")))
    return [(p.platform, p.label, p.shown, p.score) for p in df.select(links.alias("p")).first().p]


def test_links_are_ranked_and_distinct(spark):
    cell = "https://x.com/other, https://www.instagram.com/acme/ https://instagram.com/ACME; linkedin.com/company/acme-inc | https://youtube.com/@acme?x=1"
    assert parsed(spark, cell) == [
        ("youtube", "@acme", "▶ @acme", 115),
        ("instagram", "@acme", "◎ @acme", 110),
        ("linkedin", "/company/acme-inc", "in /company/acme-inc", 60),
        ("x", "/other", "X /other", 30),
    ]


def test_pages_that_are_no_profiles(spark):
    bad = ["https://youtube.com/watch?v=1", "youtu.be/abc", "https://x.com/i", "x.com", "https://facebook.com/sharer.php?u=1", "instagram.com/p/1", "https://instagram.com/a/b"]
    bad += ["linkedin.com/in/stranger", "linkedin.com/school/acme", "facebook.com/profile", "https://other.org/acme", "https://x.com/" + "a" * 29, "abc", "https://youtube.com/stranger", ""]
    assert parsed(spark, " | ".join(bad)) == [] == parsed(spark, None)
    good = "facebook.com/pages/Acme/1\nlinkedin.com/in/acme-owner;youtube.com/AcmeTV·fb.com/Acme"
    assert parsed(spark, good) == [("facebook", "/Acme", "f /Acme", 110), ("youtube", "/AcmeTV", "▶ /AcmeTV", 90), ("facebook", "/Acme", "f /Acme", 10), ("linkedin", "/in/acme-owner", "in /in/acme-owner", -5)]


def test_fit_line(spark):
    df = spark.createDataFrame([("x.com/one, x.com/two, x.com/three",)], "c string")
    links = social.parse_links(F.col("c"), F.array().cast("array<string>"))
    fit = lambda most, right: [p.label for p in df.select(social.fit_line(links, most, 10, right, 15, 15).alias("p")).first().p]
    # Widths: 21 + 6 * 7.8 = 67.8, so 68 each for the first two, 84 for the third.
    assert fit(5, 1000) == ["/one", "/two", "/three"] and fit(2, 1000) == ["/one", "/two"]
    assert fit(5, 158) == ["/one", "/two"] and fit(5, 157) == ["/one"] and fit(5, 77) == []

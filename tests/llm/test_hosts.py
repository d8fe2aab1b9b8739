"""Hosts as browsers read them."""

from spectrion.llm.url_filters import host_of
from pyspark.sql import functions as F

HOSTS = {
    "http://h.org\\@evil.com/": "h.org",
    "//h.org/x": "h.org",
    "\\\\h.org\\x": "h.org",
    "https:\\\\H.org": "h.org",
    "http://user@h.org/@evil.com": "h.org",
    "http://a@b@h.org:80/": "h.org",
    "http://[::1]:80/x": "[::1]",
    "/x//h.org": None,
    "h.org/x": None,
    "http:///x": None,
    "http://h.org.?q=//e.com": "h.org",
    None: None,
}


def test_hosts(spark):
    rows = spark.createDataFrame([(u,) for u in HOSTS], "u string").select("u", host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == HOSTS

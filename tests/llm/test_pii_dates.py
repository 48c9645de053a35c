"""Dates keep their order and widths, and different texts have different pseudonyms."""

import datetime
import re

from harvestline.llm import pii


def read(text):
    """Order and date as a reader sees them: day-first where that is a date."""
    a, b, c = map(int, re.split("[-/.]", text))
    if a > 31:
        return "ymd", datetime.date(a, b, c)
    if b <= 12:
        return ("any" if a <= 12 else "dmy"), datetime.date(c, b, a)
    return "mdy", datetime.date(c, a, b)


def test_dates_are_permuted_within_their_layout(spark):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(k) for k in range(800)]
    texts = sorted({x for d in days for x in (f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d:%m/%d/%Y}", f"{d.month}/{d.day}/{d.year}", f"{d.day}.{d.month:02}.{d.year}")})
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    new = {texts[r["doc_id"]]: r["text"] for r in rows}
    assert len(set(new.values())) == len(texts)
    for old, got in new.items():
        assert re.sub(r"\d", "9", old) == re.sub(r"\d", "9", got)
        assert read(old)[0] == read(got)[0] and 1900 <= read(got)[1].year <= 2099
    assert new["12/31/1999"] != "12/31/1999" and new["01/13/2000"] != new["13/01/2000"]


def test_all_days_of_a_layout_come_back_once(spark):
    """Brute force over a whole format: the pseudonyms of all values are all values."""
    texts = [f"{m:02}/{d:02}/{y}" for y in range(1900, 2100) for m in range(1, 13) for d in range(13, 32) if d <= pii._last_day(m)]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").select("text").collect()
    assert sorted(r["text"] for r in rows) == sorted(texts)

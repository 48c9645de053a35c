"""IBANs before other words, and dates with fields of one digit."""

import datetime
import re

from harvestline.llm import pii


def test_ibans_end_where_their_country_says(spark):
    values = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "NO9386011117947"]
    texts = [f"{v} {after}" for v in values for after in ("BIC", "2024", "EUR", "OK", "1", "and more")]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    for r in got:
        v = values[r["doc_id"] // 6]
        assert [f["value"] for f in r["found"]] == [v] and v not in r["text"]
        new = r["found"][0]["pseudonym"].replace(" ", "")
        assert r["text"].endswith(texts[r["doc_id"]][len(v) :]) and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def test_short_dates_keep_their_width_and_are_valid(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(0, 1500, 1)]
    texts = sorted({x for d in days for x in (f"{d.month}/{d.day}/{d.year}", f"{d.day}.{d.month:02}.{d.year}", f"{d.year}-{d.month}-{d.day}", f"{d.day:02}/{d.month}/{d.year}")} - {""})
    texts = [t for t in texts if len(t) < 10]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(["3/14/2020", "29.2.2020", *texts])), "doc_id long, text string"), "key").collect()
    seen = {}
    for r in got:
        (f,) = r["found"]
        assert f["kind"] == "date" and re.sub(r"\d", "9", f["value"]) == re.sub(r"\d", "9", f["pseudonym"]) == re.sub(r"\d", "9", r["text"])
        a, b, c = map(int, re.split("[-/.]", r["text"]))
        y, m, d = (a, b, c) if a > 31 else (c, b, a) if b <= 12 else (c, a, b)
        assert 1900 <= datetime.date(y, m, d).year <= 2099
        assert seen.setdefault(r["text"], f["value"]) == f["value"]

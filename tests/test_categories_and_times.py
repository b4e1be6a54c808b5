from datetime import datetime

from pyspark.sql import functions as F

from broadsheet.fixed import CATEGORIES, CATEGORY_ALL
from broadsheet.functions import categories as C, timefmt as T

V = F.col("v")


def test_flags_round_trip(one):
    masks = [0, CATEGORY_ALL, *(1 << b for b in range(19)), 24, 5 << 10, CATEGORY_ALL - 1]
    assert one(C.text_to_flags(C.flags_to_text(V)), masks, "int") == masks


def test_flag_names(one):
    assert one(C.flags_to_text(V), [0, 24, CATEGORY_ALL, CATEGORY_ALL + 1, -1], "int") == [
        "None", "Tech, Sports", "All", str(CATEGORY_ALL + 1), "-1",
    ]


def test_flag_parsing(one):
    values = [" tech , SPORTS ", "3", "+5", "Tech,", "", "bogus", "1, Tech", "99999999999", None, "all"]
    assert one(C.text_to_flags(V), values) == [24, 3, 5, 0, 0, 0, 0, 0, 0, CATEGORY_ALL]


def test_chinese_names(one):
    assert one(C.flags_to_chinese(V), [0, CATEGORY_ALL, 8, 16 | 1 << 17, 1 << 19], "int") == [
        "未分类", "全部", "科技", "体育、体育", "未分类",
    ]
    assert len(CATEGORIES) == 19


def test_labels(one):
    assert one(C.label_to_flag(V), ["news_tech", "TECH", "sport", "weather", None]) == [
        8, 8, 1 << 17, None, None,
    ]


def test_publish_times(one):
    cases = {
        "2024-01-05 08:30": "2024-01-05T08:30:00.0000000+00:00",
        " 2024/1/5 8:30:01 ": "2024-01-05T08:30:01.0000000+00:00",
        "2024年1月5日 08:30": "2024-01-05T08:30:00.0000000+00:00",
        "2024-01-05T08:30:00+08:00": "2024-01-05T00:30:00.0000000+00:00",
        "2024-01-05 08:30+0800": "2024-01-05T00:30:00.0000000+00:00",
        "2024-01-05T08:30:00.1234567Z": "2024-01-05T08:30:00.1234560+00:00",
        "2024-01-05": "2024-01-05T00:00:00.0000000+00:00",
        "2024-13-05 08:30": None,
        "2024-02-30": None,
        "2024": None,
        "昨天": None,
        "": None,
    }
    assert one(T.utc_iso(T.parse_publish_time(V)), list(cases)) == list(cases.values())


def test_local_zone_is_the_session_zone(spark, one):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert one(T.utc_iso(T.parse_publish_time(V)), ["2024-01-05 08:30"]) == [
            "2024-01-05T00:30:00.0000000+00:00"
        ]
        assert one(T.utc_iso(T.from_utc_iso(V)), ["2024-01-05T00:30:00.1000000+00:00"]) == [
            "2024-01-05T00:30:00.1000000+00:00"
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stored_time_text(one):
    assert one(T.from_utc_iso(V), ["", None, "junk"]) == [None, None, None]


def test_friendly_times(one):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    values = [
        "2024-03-10 23:59:00", "2024-03-09 00:01:00", "2024-03-08 10:00:00", "2024-03-07 10:00:00",
        "2024-03-03 10:00:00", "2024-03-02 10:00:00", "2023-12-31 10:00:00", "2025-01-01 10:00:00",
        None,
    ]
    expression = T.friendly_time(V.cast("timestamp"), now, "UTC")
    assert one(expression, values) == [
        "今天 23:59", "昨天 00:01", "前天 10:00", "星期四 10:00", "星期日 10:00", "03-02 10:00",
        "2023-12-31 10:00", "星期三 10:00", None,
    ]
    # The day is the reader's day, not the UTC day.
    assert one(T.friendly_time(V.cast("timestamp"), now, "Asia/Shanghai"), ["2024-03-09 17:00:00"]) == [
        "今天 01:00"
    ]
    assert datetime(2024, 3, 10).weekday() == 6

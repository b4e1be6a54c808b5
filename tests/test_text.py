from pyspark.sql import functions as F

from broadsheet.functions import text as X
from broadsheet.functions.core import collapse_ws, is_blank, ws_trim

V = F.col("v")


def test_white_space_of_every_kind(one):
    odd = "　a  b\t\r\n c "
    assert one(collapse_ws(V), [odd, "plain text", "  ", "a  b"]) == [
        "a b c", "plain text", "", "a b",
    ]
    assert one(ws_trim(V), [odd]) == ["a  b\t\r\n c"]
    assert one(is_blank(V), [None, "", " 　\n", "x"]) == [True, True, True, False]


def test_title_is_one_line(one):
    assert one(X.normalise_title(V), ["a\r\nb", None, " \n "]) == ["a b", "", ""]


def test_language(one):
    values = ["中文新闻", "plain words", "中文ab", "中文a", "123 !?", "", None, "日本語カナ", "é"]
    assert one(X.detect_language(V), values) == [
        "Chinese", "English", "English", "Chinese", "Unknown", "Unknown", "Unknown", "Chinese",
        "Unknown",
    ]


def test_language_threshold_is_strict(one):
    assert one(X.detect_language(V, 0.25), ["中abc", "中中abc"]) == ["English", "Chinese"]
    # A text in one script only is that language whatever the threshold.
    assert one(X.detect_language(V, 1.0), ["中文", "中文a"]) == ["Chinese", "English"]
    assert one(X.detect_language(V, -1.0), ["abc", "中abc"]) == ["English", "Chinese"]


def test_latin_tokens(one):
    values = ["Hello, World-3x", "", "中文", "ÉCOLE"]
    assert one(X.latin_tokens(V), values) == [
        ["hello", "world", "3x"], ["<UNK>"], ["<UNK>"], ["cole"],
    ]
    assert one(X.latin_token_count(V), values) == [3, 1, 1, 1]


def test_han_tokens(one):
    assert one(X.han_tokens(V), ["中文新闻AB12 国 x", "国", "...", "a国b"]) == [
        ["中文", "文新", "新闻", "ab12", "国", "x"], ["国"], ["<UNK>"], ["a", "国", "b"],
    ]


def test_long_han_run_is_linear(one):
    assert one(F.size(X.han_tokens(V)), ["国" * 200_000]) == [199_999]


def test_utf16(one):
    assert one(X.utf16_length(V), ["a😀b", "中", "", None]) == [4, 1, 0, None]
    assert one(X.utf16_left(V, 3), ["a😀b", "ab😀c", "abc😀", "xy"]) == ["a😀", "ab", "abc", "xy"]


def test_safe_name(one):
    values = ['a<b>:"c/d\\e|f?g*h', " 　 ", None, "　", "x" * 70, "t\tz", "😀" * 40]
    assert one(X.safe_name(V), values) == [
        "a_b___c_d_e_f_g_h", "untitled", "untitled", "untitled", "x" * 60, "t_z", "😀" * 30,
    ]


def test_short_hash_and_key(one):
    assert one(X.short_hash(V), ["a"]) == ["CA978112CA1B"]
    assert one(X.archive_key(V, F.lit("a")), ["T/1", ""]) == [
        "T_1_CA978112CA1B", "untitled_CA978112CA1B",
    ]


def test_cut_and_default(one):
    assert one(X.cut_text(V, 3, "…"), ["abcd", "abc"]) == ["abc…", "abc"]
    assert one(X.default_text(V, "none"), [" x ", " ", None]) == ["x", "none", "none"]
    assert one(X.link_text(V, F.lit(None).cast("string")), ["t", None]) == ["t -> ", " -> "]

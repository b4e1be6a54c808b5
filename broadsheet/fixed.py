"""Values that results depend on and that therefore must not vary.

Everything in this module is a fixed value: lists, names and patterns stated as they are
published by the sites or stored in archives.
"""

from __future__ import annotations

import json
from html.entities import html5

# White space as .NET and JavaScript understand it (Java's \s is ASCII only).
WS_CODES = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS_CHARS = "".join(map(chr, WS_CODES))
# The same as classes for Java patterns, with and without the plain blank.
_WS_RARE = r"\t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[ {_WS_RARE}]"
NON_WS = f"[^ {_WS_RARE}]"
# White space that is not one plain blank standing alone. The look-ahead turns printable ASCII
# away with a single range test; the classes are much slower.
WS_UNEVEN = f"(?! ?[!-~])(?: {WS}+|[{_WS_RARE}]{WS}*)"

# Language names.
CHINESE, ENGLISH, UNKNOWN = "Chinese", "English", "Unknown"

# Vocabulary sentinels and their ids.
PAD_TOKEN, PAD_ID = "<PAD>", 0
UNK_TOKEN, UNK_ID = "<UNK>", 1

# Category flags in bit order, with their Chinese names.
CATEGORIES = [
    ("Edu", "教育"),
    ("Entertainment", "娱乐"),
    ("House", "房产"),
    ("Tech", "科技"),
    ("Sports", "体育"),
    ("Car", "汽车"),
    ("Culture", "文化"),
    ("Game", "游戏"),
    ("Travel", "旅游"),
    ("Military", "军事"),
    ("World", "国际"),
    ("Finance", "财经"),
    ("Agriculture", "农业"),
    ("Story", "故事"),
    ("Stock", "股票"),
    ("DomesticPolitics", "国内政治"),
    ("Politics", "政治"),
    ("Sport", "体育"),
    ("Business", "商业"),
]
CATEGORY_BITS = {name: 1 << bit for bit, (name, _) in enumerate(CATEGORIES)}
CATEGORY_NONE = 0
CATEGORY_ALL = (1 << len(CATEGORIES)) - 1
ZH_NONE, ZH_ALL = "未分类", "全部"

# Raw corpus labels and the flag each one means.
CATEGORY_LABELS = [
    ("news_edu", "Edu"),
    ("news_entertainment", "Entertainment"),
    ("news_house", "House"),
    ("news_tech", "Tech"),
    ("news_sports", "Sports"),
    ("news_car", "Car"),
    ("news_culture", "Culture"),
    ("news_game", "Game"),
    ("news_travel", "Travel"),
    ("news_military", "Military"),
    ("news_world", "World"),
    ("news_finance", "Finance"),
    ("news_agriculture", "Agriculture"),
    ("news_story", "Story"),
    ("stock", "Stock"),
    ("news_domestic_politics", "DomesticPolitics"),
    ("tech", "Tech"),
    ("entertainment", "Entertainment"),
    ("politics", "Politics"),
    ("sport", "Sport"),
    ("business", "Business"),
]

# MIME type of an inline image -> file extension.
MIME_EXTENSIONS = [
    ("image/png", ".png"),
    ("image/jpeg", ".jpg"),
    ("image/jpg", ".jpg"),
    ("image/gif", ".gif"),
    ("image/webp", ".webp"),
    ("image/svg+xml", ".svg"),
]
DEFAULT_EXTENSION = ".img"
MAX_EXTENSION_LENGTH = 6

# Characters Windows refuses in a file name, and the limits on folder names.
UNSAFE_NAME_CHARS = r'["<>:*?/\\\x7C\x00-\x1F]'
UNTITLED = "untitled"
SAFE_NAME_LENGTH = 60

# Reader texts.
NO_TIME, NO_TITLE, NO_AUTHOR, NO_CONTENT = "未知时间", "无标题", "佚名", "内容为空。"
BODY_LIMIT, BODY_ELLIPSIS = 800, "……"
TODAY, YESTERDAY, DAY_BEFORE = "今天", "昨天", "前天"
WEEKDAYS = ["星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六"]

# Article URL prefixes of the two news sites.
NETEASE_PREFIXES = ["https://www.163.com/dy/article/", "https://www.163.com/news/article/"]
TOUTIAO_PREFIXES = ["https://www.toutiao.com/article/"]

# What marks a feed link as noise.
COMMENT_FRAGMENT = "#comment"
FEED_SUFFIX = "/?source=feed"
VIDEO_PATH = "/video"
COMMENT_TITLE = rf"^[0-9]+{WS}*评论$"
SOURCE_MARK = "\u3000来源:"
LEADING_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}" + WS + r"+[0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"

# Titles of navigation, footer and legal links that are never articles.
FEED_BANNED_TITLES = [
    "直播",
    "懂车帝",
    "下载头条APP",
    "关于头条",
    "侵权投诉",
    "凤凰卫视",
    "懂车时间",
    "驾享来电",
    "Yo哥真帅！（Yoko视频工作室）",
    "君子游网上围棋教室",
    "扫黄打非网上举报",
    "网络谣言曝光台",
    "网上有害信息举报",
    "侵权举报受理公示",
    "京ICP证140141号",
    "京ICP备12025439号-3",
    "网络文化经营许可证 京网文〔2023〕3628-111号",
    "营业执照",
    "广播电视节目制作经营许可证",
    "出版物经营许可证",
    "营业性演出许可证",
    "药品医疗器械网络信息服务备案编号：（京）网药械信息备字（2023）第00006号",
    "跟帖评论自律管理承诺书",
    "京公网安备 11000002002023号",
    "网信算备110108823483902220017号",
    "网信算备110108823483904220019号",
    "网信算备110108823483903230017号",
    "互联网宗教信息服务许可证：京（2025）0000021",
    "加入头条",
    "用户协议",
    "隐私政策",
    "媒体合作",
    "广告合作",
    "友情链接",
    "媒体报道",
    "产品合作",
    "头条MCN",
    "联系我们",
    "廉洁举报",
    "企业认证",
    "免责声明",
    "下载今日头条APP",
]
PORTAL_BANNED_TITLES = [
    "注册",
    "登录",
    "发布器",
    "首页",
    "站长力推信誉网投【5717.COM】集团直营★AG女优发牌★万人棋牌★捕鱼爆大奖★注册瓜分百万彩金",
    "【威尼斯人集团◆上市公司】★★顶级信誉★■★每月亿元返利★■★大额无忧★■★返水3.0%无上限★",
    "清除 Cookies",
    "Archiver",
    "WAP",
    *FEED_BANNED_TITLES,
]

# HTML character references that occur in running text.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\u00a0",
    "ensp": "\u2002",
    "emsp": "\u2003",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "middot": "·",
    "bull": "•",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "laquo": "«",
    "raquo": "»",
    "times": "×",
    "deg": "°",
    "sect": "§",
    "para": "¶",
    "yen": "¥",
    "pound": "£",
    "cent": "¢",
    "euro": "€",
}

# Character references by the standard library's table of the HTML standard: all names with a
# semicolon as one JSON object, the old names that may lack it, longest first, and the numbers
# of the C1 controls, which stand for Windows-1252 characters.
NAMES_JSON = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
CONTROL_REFERENCES = {
    str(code): char
    for code in range(0x80, 0xA0)
    if (char := bytes([code]).decode("cp1252", "ignore"))
}

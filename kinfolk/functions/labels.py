"""Rewriting of labels in finished texts by an ordered table of rules, as one expression.

A table must settle: applied to what it has made it changes nothing more. unsettled() finds the texts for which it does
not, residual() the old labels that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRMED, REVIEW, NONE = "高置信同源代码", "模型复核后仍存疑", "暂未检出相似"

#: Old labels of reports and what stands for them now, in the order of application. A pattern in slashes is a
#: regular expression ($1 is what its first group matched), any other is taken as it is.
REPORT_RULES = [
    ("自研/原创（函数）", f"{NONE}（函数）"),
    ("自研/原创", NONE),
    ("原创代码清单", "暂未检出相似清单"),
    (r"/(<h2[^>]*>)原创代码(</h2>)/", "$1暂未检出历史相似（不等于原创）$2"),
    (">原创代码</", ">暂未检出相似</"),
    (
        r"/共 <b>(\d+)</b> 个函数未与历史代码库构成借鉴.*?（按规模降序，全部列出）：/",
        "共 <b>$1</b> 个函数在当前历史库中暂未形成有效相似命中。"
        "<b>这只表示系统暂未检出，不等于原创认定</b>；可能仍受历史库覆盖、召回与阈值影响。"
        "以下按规模降序全部列出，供继续人工核验：",
    ),
    ("未发现原创函数", "没有暂未命中的函数"),
    ("原创度高", "当前库内相似命中较少"),
    ("原创性较高", "当前库内相似命中较少"),
    ("疑似借鉴占自研代码", "疑似借鉴占纳入统计函数"),
    ("疑似借鉴占自研函数", "疑似借鉴占纳入统计函数"),
    ("作品自研部分", "排除机械重复后的待评估部分"),
    ("个自研函数中标记出", "个纳入统计函数中标记出"),
    ("按自研函数加权", "按纳入统计函数加权"),
    ("下列数字均为<b>自研代码</b>口径", "下列数字为<b>待评估代码</b>口径"),
    ("绝大多数函数为自研实现，仅少量与历史作品高度相似，原创性良好。", "当前历史库中仅检出少量高度相似函数；未命中不等于已证明原创。"),
    (r"/原创 (\d+(?:\.\d+)?%)/", "暂未检出相似 $1"),
    (r"// 原创 (\d+)/", "/ 暂未检出 $1"),
    ("原创 占比", "暂未检出相似 占比"),
    ("疑似借鉴（与历史代码逐行高度相似，待人工判定）", f"{CONFIRMED}（与历史代码逐行高度相似）"),
    ("疑似借鉴·待人工判定", CONFIRMED),
    ("已确认借鉴", CONFIRMED),
    ("高度疑似借鉴", CONFIRMED),
    ("高度疑似", "高置信同源"),
    ("needReview（疑似借鉴）", REVIEW),
    ("needReview", REVIEW),
    ("弱相似", REVIEW),
    ("疑似借鉴（待复核）", REVIEW),
    (r"/(?<!度)疑似借鉴（函数）/", f"{REVIEW}（函数）"),
    ("待复核", REVIEW),
    ("待人工判定", "需人工确认"),
    ("&nbsp;借鉴</div>", f"&nbsp;{CONFIRMED}</div>"),
    ("&nbsp;疑似借鉴</div>", f"&nbsp;{REVIEW}</div>"),
    ("&nbsp;原创</div>", f"&nbsp;{NONE}</div>"),
    ("&nbsp;自研/原创</div>", f"&nbsp;{NONE}</div>"),
    (r'/("name":\s*")(?:借鉴|疑似借鉴)("(?:(?!"name").)*?#ef4444)/', f"$1{CONFIRMED}$2"),
    (r'/("name":\s*")(?:疑似借鉴|待复核|疑似借鉴（待复核）)("(?:(?!"name").)*?#f59e0b)/', f"$1{REVIEW}$2"),
    (r'/("name":\s*")(?:原创|自研/原创|暂未检出相似)("(?:(?!"name").)*?#(?:22c55e|16a34a))/', f"$1{NONE}$2"),
    ('"data": ["借鉴", "疑似借鉴", "原创"]', f'"data": ["{CONFIRMED}", "{REVIEW}", "{NONE}"]'),
    ('"data": ["借鉴", "原创"]', f'"data": ["{CONFIRMED}", "{NONE}"]'),
    ('"data": ["疑似借鉴", "待复核", "自研/原创"]', f'"data": ["{CONFIRMED}", "{REVIEW}", "{NONE}"]'),
    ('"data": ["高度疑似借鉴", "疑似借鉴（待复核）", "暂未检出相似"]', f'"data": ["{CONFIRMED}", "{REVIEW}", "{NONE}"]'),
    ('"data": ["疑似借鉴", "自研/原创"]', f'"data": ["{CONFIRMED}", "{NONE}"]'),
    ('"data": ["疑似借鉴"]', f'"data": ["{CONFIRMED}"]'),
    (r'/(title=")借鉴 /', f"$1{CONFIRMED} "),
    (r"/ / 疑似借鉴 (\d)/", f" / {REVIEW} $1"),
]
#: Fixed value: the note put into a page that does not say which recall it was made with.
STALE_NOTE = (
    '<section id="retrieval-stale" data-retrieval-contract-version="missing" '
    'data-retrieval-complete="false" style="margin:12px;padding:14px;border:2px solid #dc2626;'
    'border-radius:8px;background:#fef2f2;color:#991b1b">'
    "<b>⚠ 旧版查重报告已失效，必须按完整召回链重跑</b><br>"
    '<span style="font-size:13px">本报告生成时未记录历史库完整覆盖、索引代际和无静默截断契约；'
    "仅可用于定位历史问题，不得据此认定任何函数原创或未借鉴。</span></section>"
)
#: Labels that must not be left.
LEGACY = ("已确认借鉴", "高度疑似借鉴", "高度疑似", "needReview", "疑似借鉴·待人工判定", "待人工判定", "待复核", "弱相似", "&nbsp;借鉴</div>", "&nbsp;疑似借鉴</div>")


def _pattern(rule: str) -> str | None:
    return rule[1:-1] if len(rule) > 2 and rule[0] == rule[-1] == "/" else None


def rewritten(text: Column, rules: list[tuple[str, str]] = REPORT_RULES) -> Column:
    """The text after all rules, one after the other."""
    for rule, stands in rules:
        pattern = _pattern(rule)
        text = F.replace(text, F.lit(rule), F.lit(stands)) if pattern is None else F.regexp_replace(text, f"(?s){pattern}", stands)
    return text


def residual(text: Column, labels: tuple[str, ...] = LEGACY) -> Column:
    """The labels that a text still has, in their order."""
    return F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(text, x))


def unsettled(texts: DataFrame, column: str, rules: list[tuple[str, str]] = REPORT_RULES) -> DataFrame:
    """The rows whose text the rules would change again after they were applied, with once and twice."""
    once = texts.withColumn("once", rewritten(F.col(column), rules))
    return once.withColumn("twice", rewritten(F.col("once"), rules)).filter("once <> twice")


def with_stale_note(html: Column) -> Column:
    """A whole page with the note behind its first body tag, unless it says what recall it was made with."""
    silent = F.contains(html, F.lit("<body")) & ~F.contains(html, F.lit("data-retrieval-contract-version=")) & ~F.contains(html, F.lit('id="retrieval-stale"'))
    tag = F.regexp_extract(html, r"(?i)(<body\b[^>]*>)", 1)
    at = F.position(tag, html) + F.length(tag)
    noted = F.concat(F.substring(html, F.lit(1), at - 1), F.lit(STALE_NOTE), F.substring(html, at, F.length(html)))
    return F.when(silent & (tag != ""), noted).otherwise(html)

"""Word lists and patterns that results depend on. They must stay as they are."""

from __future__ import annotations

STOPWORDS = (
    "a an and are as at be by did do does for from had has have how i in is it me my of on or that the their them they this to was were "
    "what when where which who why with would you your "
    "为什么 为何 什么 他们 他的 你们 哪个 哪些 多少 她的 如何 怎么 我们 我的 是否 这个 那个"
).split()

LATEST_MARKERS = "latest current currently now newest recent last 最近 最新 当前 现在 最后".split()
EARLIEST_MARKERS = "earliest first initial originally 最早 最初 第一次 起初".split()
UPDATE_MARKERS = "actually instead changed updated correction corrected now 其实 改成 改为 更正 更新 现在 后来".split()

#: Groups of related terms; members in code point order.
CONCEPTS = [
    group.split()
    for group in (
        "enjoy favorite favourite like love prefer preference",
        "city country home live lives living move moved relocated 住 住哪 住在 北京 在住 搬到 搬家",
        "career company job occupation profession role work 上班 公司 公司上班 工作 职业",
        "college degree education school studied study university 大学 学习 学校 学校读书 读书",
        "author book novel read reading 书 什么书 作者 小说 看书 看什么 看什么书 阅读",
        "artist band listen music song 乐队 什么歌 听 听什么 听什么歌 歌 歌手 音乐",
        "coffee drink eat food meal restaurant tea 吃 咖啡 喜好 喜欢 喝 茶 菜 餐 饭 饮品",
        "doctor health medical medicine treatment 健康 医生 医疗 治疗 身体",
        "child children family friend parent partner spouse 孩子 家人 家庭 朋友 父母 谁",
        "camping hiking holiday travel trip vacation visit 出去玩 去了哪里 参观 度假 旅游 旅行",
        "goal going intend plan planning will 准备 打算 计划",
        "change correction current instead latest update 改成 更正",
        "after before earlier first last later 之前 之后 后来",
    )
]

# Patterns, in the dialect of java.util.regex.
WORD = r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)*"
CJK_CLASS = r"㐀-䶿一-鿿豈-﫿"
CJK = f"[{CJK_CLASS}]+"
CLAUSE_BREAK = r"(?iU)(?<=[.!?])\s+|[。！？;；]+|\b(?:and|also)\b|以及|另外|同时"
EXPLICIT_DATE = r"(?U)(?<![A-Za-z0-9_-])(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日)(?![A-Za-z0-9_-])"
DATE_TEXT = r"(?U)\d{4}-(?:\d{1,2})-(?:\d{1,2})|\d{4}年\s*\d{1,2}月\s*\d{1,2}日"
DAY_CUE_BEFORE = r"(?iU)\b(?:on|at|during|as of)\s*$|[在于]\s*$"
DAY_CUE_AFTER = r"(?U)^\s*(?:当天|当日|那天|这天)"
DATE_ATTRIBUTE = r"(?iU)\b(?:due|deadline|scheduled|appointment|expires?|expiry|expiration)\b|到期|截止|期限|预约|预定"
DATE_FIRST_EVENT = r"(?U)^\s*(?:我|他|她|我们|他们).{0,40}(?:住|去|到|在哪里|发生|做了什么)"
SUMMARY_ACTION = r"(?iU)\b(?:summari[sz]e|summary\s+of|overview\s+of)\b"
SUMMARY_SCOPE = r"(?iU)\b(?:history|timeline|conversation|sessions?|stages?|journey|evolution|progress|experiences?)\b|\bover\s+time\b"
SUMMARY_CHINESE = r"(?:总结|概述|综述).{0,80}(?:各阶段|整个|全部|所有|历程|变化|历史|进展)|(?:各阶段|整个|全部|所有|历程|变化|历史|进展).{0,80}(?:总结|概述|综述)"
CHUNK_INDEX = r"(?:^|[-_:])chunk[-_:]?(\d+)(?:$|[-_:])"
NO_CHUNK = 1_000_000_000
QUERY_WORD_DROPPED = f"(?U)[^\\w{CJK_CLASS}]+"
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "bearer_literal": r"\bBearer\s+(?!\$)[A-Za-z0-9._-]{20,}",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
}

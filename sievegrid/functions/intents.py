"""Keyword tables and the intent of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default keyword lists.
URGENT = ["urgent", "immediately", "limited time", "within 24 hours", "account suspended", "verify now", "紧急", "立即", "马上", "限时", "过期", "暂停", "冻结"]
SENSITIVE = ["password", "verification code", "credit card", "bank card", "login", "credential", "verification", "密码", "验证码", "银行卡", "身份证", "账户", "账号", "登录"]
BRANDS = ["paypal", "microsoft", "apple", "google", "amazon", "alipay", "bank", "wechat", "office 365", "腾讯", "阿里", "支付宝", "微信", "银行"]
CATEGORIES = {
    "credential": ["password", "passcode", "credential", "verification code", "security code", "密码", "验证码", "口令", "登录信息"],
    "payment": ["payment", "invoice", "wire transfer", "bank account", "beneficiary", "付款", "发票", "转账", "收款账户", "银行账户"],
    "download": ["download", "open the attachment", "enable macros", "shared document", "下载", "打开附件", "启用宏", "共享文件"],
    "reply": ["reply", "respond", "send me", "provide the", "confirm by email", "回复", "回信", "发送给我", "提供", "邮件确认"],
    "authorization": ["device code", "verification page", "authorize", "oauth", "approve sign-in", "设备代码", "授权", "批准登录", "身份验证页面"],
    "urgency": ["urgent", "immediately", "within 24 hours", "final warning", "act now", "紧急", "立即", "马上", "限时", "最后通知"],
    "authority": ["chief executive", "ceo", "director", "administrator", "human resources", "总经理", "董事", "管理员", "人力资源", "领导"],
    "secrecy": ["confidential", "do not discuss", "keep this private", "between us", "保密", "不要告诉", "不要讨论", "仅限你我"],
    "bypass": ["skip approval", "bypass", "do not call", "outside the process", "跳过审批", "绕过", "不要电话确认", "特殊流程"],
}
ACTION_CATEGORIES = ["credential", "payment", "download", "authorization"]
INTENTS = {
    "credential_request": ["password", "passcode", "verification code", "security code", "密码", "验证码", "口令", "登录信息"],
    "oauth_authorization": ["oauth", "authorize", "authorization", "device code", "approve sign-in", "设备代码", "授权", "批准登录"],
    "payment_change": ["wire transfer", "bank account", "beneficiary", "payment", "invoice", "付款", "收款账户", "银行账户", "发票", "转账"],
    "external_document_action": ["shared document", "open the attachment", "download", "enable macros", "cloud document", "共享文件", "打开附件", "下载", "启用宏", "云文档"],
    "reply_or_data_request": ["reply", "respond", "send me", "provide the", "confirm by email", "回复", "回信", "发送给我", "提供", "邮件确认"],
    "social_pressure": ["urgent", "immediately", "within 24 hours", "final warning", "act now", "紧急", "立即", "马上", "限时", "最后通知", "confidential", "do not discuss", "保密"],
    "benign_notice": ["no action is required", "for your records", "this is an automated notification", "无需操作", "仅供参考", "自动通知"],
}
ACTION_INTENTS = ["credential_request", "oauth_authorization", "payment_change", "external_document_action", "reply_or_data_request"]
NEGATIONS = [
    "no action is required", "not required", "never ask", "will never ask", "do not request", "has not changed", "no change", "usual company portal", "normal support channel",
    "无需操作", "不会索取", "不会要求", "不要求回复", "没有变更", "正常渠道",
]


def listed(patterns: list[str]) -> Column:
    return F.array(*(F.lit(p.lower()) for p in patterns))


def contains_any(lowered: Column, patterns: list[str]) -> Column:
    return F.exists(listed(patterns), lambda p: F.contains(lowered, p))


def first_match(lowered: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that occurs, or empty."""
    return F.coalesce(F.get(F.filter(listed(patterns), lambda p: F.contains(lowered, p)), F.lit(0)), F.lit(""))


def hit_count(lowered: Column, patterns: list[str]) -> Column:
    """Occurrences of all patterns, those of one pattern not overlapping."""
    left = lambda p: F.length(lowered) - F.length(F.replace(lowered, F.lit(p.lower()), F.lit("")))
    counts = [(left(p) / len(p)).cast("int") for p in patterns]
    return sum(counts[1:], counts[0])


def with_intent_features(df: DataFrame, text: str, categories: dict[str, list[str]] | None = None, actions: list[str] | None = None, urgency: str = "urgency") -> DataFrame:
    """Adds hits and presence of each category, and the three counts across them, as doubles. The counts are columns first, so that each is taken once."""
    categories, actions = categories or CATEGORIES, actions or ACTION_CATEGORIES
    df = df.withColumn("_low", F.lower(text)).withColumns({f"{name}_hits": hit_count(F.col("_low"), patterns).cast("double") for name, patterns in categories.items()})
    hits = {name: F.col(f"{name}_hits") for name in categories}
    add = lambda cs: sum(cs[1:], cs[0])
    some = {name: (h > 0).cast("double") for name, h in hits.items()}
    across = {
        "intent_category_count": add(list(some.values())),
        "intent_hit_count": add(list(hits.values())),
        "urgency_action_pair": ((hits[urgency] > 0) & (add([hits[a] for a in actions]) > 0)).cast("double"),
    }
    return df.withColumns({f"{name}_present": s for name, s in some.items()} | across).drop("_low")


def intent_names(categories: dict[str, list[str]] | None = None) -> list[str]:
    """The columns that with_intent_features() adds, in order."""
    names = list(categories or CATEGORIES)
    return [f"{n}_hits" for n in names] + [f"{n}_present" for n in names] + ["intent_category_count", "intent_hit_count", "urgency_action_pair"]


def weak_intents(lowered: Column, intents: dict[str, list[str]] | None = None, actions: list[str] | None = None, negations: list[str] | None = None, benign: str = "benign_notice") -> Column:
    """Sorted names of the intents whose patterns occur. A negation takes the action intents away; the benign one stands only without them."""
    intents, actions, negations = intents or INTENTS, actions or ACTION_INTENTS, negations or NEGATIONS
    names = F.array_compact(F.array(*(F.when(contains_any(lowered, p), F.lit(n)) for n, p in intents.items())))
    acts = F.array(*map(F.lit, actions))
    quiet = F.array_except(names, acts)
    quiet = F.when(F.size(quiet) == 0, F.array(F.lit(benign))).otherwise(quiet)
    names = F.when(contains_any(lowered, negations), quiet).otherwise(names)
    return F.array_sort(F.when(F.arrays_overlap(names, acts), F.array_remove(names, benign)).otherwise(names))

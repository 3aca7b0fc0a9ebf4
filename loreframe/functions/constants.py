"""Word lists, patterns, weights and formats needed for equal results."""

# Unicode white space as one class usable in Java and RE2 patterns.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

# Domain words, in order.
DOMAIN_WORDS = [
    "团体报告", "测评报告", "报告", "生成", "导出", "下载", "登录", "密码", "账号", "账户",
    "订单", "退款", "发票", "上传", "配置", "审核", "失败", "报错", "无法", "权限", "微信",
    "后台", "状态", "进度",
]

# Chat keywords, in order; the first four found are kept.
CHAT_KEYWORDS = [
    "退款", "退货", "签收", "账号", "密码", "后台", "报告", "生成", "下载", "派发", "测评",
    "发票", "地址",
]
LOW_VALUE_CONTENTS = ["收到", "好的", "好", "👌", "[表情]", "[图片]"]
LOW_VALUE_SPEAKER = "[系统]"

# Intent rules, first match wins.
SENSITIVE_WORDS = [
    "api key", "apikey", "secret", "access token", "system prompt", "系统提示词", "密钥",
    "数据库密码", "微信 token", "后台密码",
]
REALTIME_WHEN = ["现在", "当前", "实时", "到哪一步", "处理到哪", "有没有完成", "是否完成", "进度"]
REALTIME_WHAT = ["状态", "报告", "订单", "账号", "后台", "生成", "处理"]
TROUBLE_WORDS = [
    "怎么办", "无法", "不能", "失败", "报错", "没有生成", "没生成", "打不开", "登不上", "异常",
]
PROCEDURE_WORDS = ["怎么", "如何", "步骤", "流程", "操作", "在哪里", "导出", "上传", "配置"]
SMALLTALK = ["你好", "您好", "谢谢", "感谢", "在吗"]
INTENTS = [
    "faq_exact", "procedure", "troubleshooting", "realtime_status", "chitchat_or_out_of_scope",
    "sensitive_or_forbidden",
]

# Lexical weights for title / search text / content.
PHRASE_WEIGHTS = {"source_title": 0.45, "search_text": 0.35, "content": 0.20}
TERM_WEIGHTS = {"source_title": 0.18, "search_text": 0.12, "content": 0.06}
MAX_TERMS = 20
RRF_K = 60
TOP_K = 5
MIN_SCORE = 0.35

# Dedup phrase folding, in order, and the characters that are dropped.
DEDUPE_FOLDS = [
    ("多久到账", "需要多久"),
    ("多久到", "需要多久"),
    ("多长时间到账", "需要多久"),
    ("通常", "一般"),
]
DEDUPE_PUNCTUATION = "，。！？、,.!?;；:：'\"“”‘’（）()[]【】《》<>"
DEDUPE_LEVELS = [(0.92, "high"), (0.85, "medium"), (0.75, "low")]

# Parsed-layout block types.
PAGE_CHROME_TYPES = [
    "discarded", "footer", "header", "page_aside_text", "page_footer", "page_header", "page_number",
]
CONTENT_TYPES = [
    "code", "equation", "equation_interline", "image", "list", "table", "text", "title",
]
KB_BLOCK_TYPES = {
    "paragraph": "text", "list": "text", "table": "table", "image": "figure",
    "equation_interline": "formula", "title": "title", "page_header": "noise",
    "page_footer": "noise", "page_number": "noise", "header": "noise", "footer": "noise",
    "page_aside_text": "noise", "text": "text",
}
# Low-value section titles, matched on the lower-cased, space-collapsed title.
SKIP_SECTION_PATTERN = (
    r"^(contents\s*$|table of contents\s*$|list of figures\s*$|list of tables\s*$|rev\.\s*\w+"
    r"|revision\s*history\s*$|document\s*history\s*$|change\s*history\s*$)"
)
SENTENCE_ENDERS = ".。！？!?；;：:\n"
CHUNKER_TYPES = ["manual", "naive", "qa", "table"]
UNSECTIONED = "未分章节"

# Graph enumerations.
ENTITY_TYPES = [
    "product_platform_module", "feature_ui_action", "error_symptom", "process_task_object",
    "role_permission_channel", "condition_policy",
]
RELATION_TYPES = [
    "belongs_to", "requires", "causes", "resolves_by", "blocked_by", "available_for",
    "escalate_when",
]

# Evaluation strategies and the only valid contract version.
EVAL_STRATEGIES = ["retrieval_hybrid_v1", "retrieval_hybrid_v1_kg_debug"]
EVAL_CONTRACT = 2

# Conversation limits.
RECENT_MESSAGES = 10
CONTEXT_CHARS = 1200
SUMMARY_LINE_CHARS = 120
PROMPT_MESSAGES = 12

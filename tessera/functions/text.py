"""Text functions as column expressions: normalisation, tokens, byte budgets, credentials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: phrases that questions are asked with, in the order they are taken out
STOP_PHRASES = ["是谁", "是什么", "是啥", "请问", "怎么", "如何", "告诉我", "严格", "按照", "不要补充", "的区别", "区别", "吗", "呢", "？", "?"]
# fixed values: words that point back to what was said before, and phrases that change the topic
POINTERS = ["它", "他们", "她们", "这个", "那个", "前者", "后者", "上述", "继续", "刚才"]
TOPIC_CHANGES = ["换个话题", "换一个话题"]
# fixed values: what looks like a credential
CREDENTIAL = (
    r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk-[a-z0-9_-]{16,}|\bBearer\s+[a-z0-9_.-]{16,}|"
    r"(?:password|passwd|api[_ -]?key|access[_ -]?token|secret|密码|密钥|令牌)\s*[:=：]\s*\S+)"
)
# fixed values: names of file types by extension
FILE_TYPES = {"pdf": "PDF文档", "doc": "Word文档", "docx": "Word文档", "xls": "Excel表格", "xlsx": "Excel表格", "ppt": "PowerPoint演示文稿", "pptx": "PowerPoint演示文稿", "txt": "文本文件", "md": "Markdown文档"}

#: One token for each Han character, one for each run of other letters and digits.
#: ASCII stands first, as the rest takes a look at each character's script.
TOGETHER, ALONE = r"[a-z0-9[\p{L}\p{N}&&[^\p{IsHan}]]]", r"\p{IsHan}"
TOKEN = f"({TOGETHER}+|{ALONE})"


def normalized(text: Column) -> Column:
    """A question without its asking words and signs; empty if nothing is left."""
    out = F.lower(text)
    for phrase in STOP_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    out = F.regexp_replace(out, r"[^\p{IsHan}a-z0-9 \t\n\f\r]", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\f\r]+", " "))


def search_text(text: Column) -> Column:
    """What is matched: the normalised question, or the question itself if that is empty."""
    n = normalized(text)
    return F.when(n == "", text).otherwise(n)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def estimate(text: Column) -> Column:
    """Bytes of the UTF-8 form, the unit of every budget."""
    return F.octet_length(F.coalesce(text, F.lit("")))


def message_cost(messages: Column) -> Column:
    """Bytes of a list of (role, content) with their frames."""
    return F.aggregate(messages, F.lit(16).cast("long"), lambda s, m: s + 16 + estimate(m["role"]) + estimate(m["content"]))


def pair_cost(question: Column, answer: Column) -> Column:
    """What a turn adds to the cost of a message list."""
    return F.lit(32 + 4 + 9) + estimate(question) + estimate(answer)


def bounded(text: Column, most: int) -> Column:
    """Valid, not blank, and at most so many code points."""
    return F.coalesce(F.is_valid_utf8(text) & (F.regexp_replace(text, r"^\s+|\s+$", "") != "") & (F.char_length(text) <= most), F.lit(False))


def truncated(text: Column, most: int) -> Column:
    """Within a byte budget: the text, or its longest whole-character beginning with an ellipsis."""
    clean = F.make_valid_utf8(text)
    clean = F.replace(clean, F.lit("�"), F.lit(""))
    if most < 3:
        return F.when(F.octet_length(clean) <= most, clean).otherwise("")
    # code points are one to four bytes: only lengths up to the budget can fit
    lengths = F.sequence(F.lit(0), F.least(F.char_length(clean), F.lit(most - 3)))
    fit = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.substring(clean, F.lit(1), n)) <= most - 3))
    return F.when(F.octet_length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, F.lit(1), fit), F.lit("…")))


def shortened(text: Column, most: int) -> Column:
    """At most so many code points, with an ellipsis where something is cut."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def error_text(text: Column) -> Column:
    return F.substring(text, 1, 1000)


def tags(csv: Column) -> Column:
    """Trimmed, non-empty entries of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def has_tag(csv: Column, tag: Column) -> Column:
    return F.array_contains(tags(csv), tag)


def follows_up(question: Column) -> Column:
    """Whether a question points back to the conversation so far."""
    out = F.lit(False)
    for word in POINTERS:
        out = out | F.contains(question, F.lit(word))
    for phrase in TOPIC_CHANGES:
        out = out & ~F.contains(question, F.lit(phrase))
    return out & (F.char_length(question) <= 100)


def has_credential(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(CREDENTIAL)), F.lit(False))


def context_text(prefix: Column, body: Column) -> Column:
    """A body below its context prefix."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", body).otherwise(F.concat(F.regexp_replace(prefix, r"\n+$", ""), F.lit("\n"), body))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def file_type(name: Column) -> Column:
    e = extension(name)
    known = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.when(e == "", "未知类型").otherwise(F.coalesce(F.try_element_at(known, e), F.concat(F.upper(e), F.lit("文件"))))


def object_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def document_upload_prefix(kind: str, user_id: Column, document_id: Column) -> Column:
    """Where a document's parts (``chunks``) or its whole file (``merged``) lie."""
    return F.concat(object_key(kind, user_id, document_id), F.lit("/"))


def document_ir_prefix(user_id: Column, document_id: Column) -> Column:
    return document_upload_prefix("document-ir", user_id, document_id)


def part_key(user_id: Column, document_id: Column, index: Column) -> Column:
    return F.concat(document_upload_prefix("chunks", user_id, document_id), index.cast("string"))


def attempt_key(user_id: Column, document_id: Column, index: Column, attempt: Column) -> Column:
    """Where one try at a part lies until it counts."""
    return F.concat(document_upload_prefix("chunks", user_id, document_id), F.lit("attempts/"), index.cast("string"), F.lit("/"), attempt)


def merged_key(user_id: Column, document_id: Column, token: Column) -> Column:
    return F.concat(document_upload_prefix("merged", user_id, document_id), token)


def artifact_key(user_id: Column, document_id: Column, version: Column) -> Column:
    return F.concat(document_ir_prefix(user_id, document_id), version, F.lit("/ir.json"))


def shown_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def iso_time(at: Column) -> Column:
    """Without a zone."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def day_of(text: Column) -> Column:
    """The day a text names, null where it names none."""
    return F.try_to_date(text, "yyyy-MM-dd")


def eight_hours_east(at: Column) -> Column:
    """A moment of UTC as clocks at UTC+8 show it."""
    return at + F.expr("interval 8 hours")


def valid_user_name(name: Column) -> Column:
    """1 to 32 letters, digits and _ - ."""
    return F.coalesce(F.rlike(name, F.lit(r"^[\p{L}\p{Nd}_.-]{1,32}\z")), F.lit(False))


def valid_conversation_id(name: Column) -> Column:
    """1 to 64 visible ASCII signs."""
    return F.coalesce(F.rlike(name, F.lit(r"^[!-~]{1,64}\z")), F.lit(False))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)), F.lit(6))), F.lit(60.0))


def substituted(template: Column, values: Column) -> Column:
    """A step's question with the values of earlier steps (map of step number to text) in their places."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{step:"), e["key"].cast("string"), F.lit("}}")), e["value"]))


def page_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, from_bottom: Column) -> Column:
    """A bounding box in shares of the page, from its top left corner; null without a page."""
    t, b = F.when(from_bottom, height - top).otherwise(top), F.when(from_bottom, height - bottom).otherwise(bottom)
    unit = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in (F.try_divide(left, width), F.try_divide(F.least(t, b), height), F.try_divide(right, width), F.try_divide(F.greatest(t, b), height))]
    return F.when((width != 0) & (height != 0), F.array(*unit))


def set_bits(bitmap: Column, total: Column) -> Column:
    """Indices of the set bits of a bitmap, most significant bit of each byte first."""
    hexed = F.hex(bitmap)
    every = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def is_set(i: Column) -> Column:
        digit = F.substring(hexed, F.floor(i / 4).cast("int") + 1, F.lit(1))
        value = F.instr(F.lit("0123456789ABCDEF"), digit) - 1
        power = F.element_at(F.array(*[F.lit(v) for v in (8, 4, 2, 1)]), (i % 4 + 1).cast("int"))
        return (F.floor(i / 4) < F.length(hexed)) & (F.floor(value / power).cast("int") % 2 == 1)

    return F.filter(every, is_set)

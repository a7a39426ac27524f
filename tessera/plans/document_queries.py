"""Queries of parsing, chunking, validation and spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import roles
from ..operators import chunking, validation
from ..session import parts, spread
from ..sources.parse import Document

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir) -> DataFrame:
    d = spread(roles.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select((F.col("doc_id") + 1).alias("document_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def pages(spark, sf_dir) -> DataFrame:
    return spread(roles.table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("document_id"), F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"), F.col("html").cast("binary").alias("content"))


@query("select doc_id, k as line_no, line from (select doc_id, unnest(l) as line, generate_subscripts(l, 1)::int as k from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n]+') as l from documents))")
def text_lines(spark, sf_dir) -> DataFrame:
    lines = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\n]+"), 0)
    return roles.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


@query("""select doc_id, k as line_no, (stop - length(line))::bigint as start, stop::bigint as "end" from (select doc_id, k, line, sum(length(line)) over w + k - 1 as stop from
(select doc_id, unnest(l) as line, generate_subscripts(l, 1)::int as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)) window w as (partition by doc_id order by k rows between unbounded preceding and current row))""")
def line_spans(spark, sf_dir) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    lines_ = rows.select("doc_id", F.posexplode("l").alias("k", "line"))
    end = F.sum(F.char_length("line") + 1).over(W.partitionBy("doc_id").orderBy("k")) - 1
    return lines_.select("doc_id", (F.col("k") + 1).alias("line_no"), "line", end.alias("end")).withColumn("start", F.col("end") - F.char_length("line")).select("doc_id", "line_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("select doc_id + 1 as document_id, 'paragraph' as type, text from documents where trim(coalesce(text, '')) <> ''")
def text_blocks(spark, sf_dir) -> DataFrame:
    parsed = chunking.parse_and_chunk(documents(spark, sf_dir))
    return parsed.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.type", "b.text")


# without heads, comments and other tags, text between tags that begin or end a block; all headings of the pages are of level 1
HTML_BLOCKS_SQL = r"""with raw as (select page_id as document_id, regexp_replace(regexp_replace(html, '<head>.*?</head>', '', 's'), '<!--.*?-->', '', 'gs') as x from pages),
cut as (select document_id, regexp_replace(regexp_replace(replace(x, '<br>', chr(10)), '<(p|li|pre|h1|/p|/li|/pre|/h1|/div)( [^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '<[^>]*>', '', 'g') as y from raw),
seg as (select document_id, unnest(string_split(y, chr(1))) as s, generate_subscripts(string_split(y, chr(1)), 1) as k from cut),
par as (select document_id, k, case when k = 1 then '' else split_part(s, chr(2), 1) end as tag, case when k = 1 then s else split_part(s, chr(2), 2) end as t from seg),
txt as (select document_id, k, tag, trim(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13)) as text from par),
blk as (select document_id, row_number() over (partition by document_id order by k) - 1 as n, case tag when 'li' then 'list_item' when 'pre' then 'code' when 'h1' then 'heading' else 'paragraph' end as type, text from txt where text <> '')
select document_id, 'b' || n as block_id, type, text, coalesce(last_value(case when type = 'heading' then text end ignore nulls) over (partition by document_id order by n), '') as path from blk"""


@query(HTML_BLOCKS_SQL)
def html_blocks(spark, sf_dir) -> DataFrame:
    """Blocks of all pages, whatever their size; a page that can't be parsed is an error of the query, not a page without blocks."""
    rows = chunking.block_rows(pages(spark, sf_dir))
    return rows.select("document_id", "block_id", "type", "text", F.array_join("heading_path", " / ").alias("path"))


# A document of plain text is one block. Its sentences are marked, those without tokens go with the next; a parent of a document
# beyond 2000 tokens takes sentences up to 1500, a child up to 450, unless the whole document fits one of 600; a sentence that
# passes 600 is windows of 593 tokens, 520 apart, for each 1993 of its tokens
CHUNKS_SQL = r"""with recursive src as (select doc_id + 1 as document_id, text from documents where trim(coalesce(text, '')) <> ''),
mk as (select document_id, text, replace(regexp_replace(regexp_replace(text, '([。！？!?；;]+[”’"''」』）》）]*)', '\1' || chr(1), 'g'), '(\.[”’"''」』）》）]*)(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)) as m from src),
un as (select document_id, unnest(string_split(m, chr(1))) as t, generate_subscripts(string_split(m, chr(1)), 1) as i from mk),
cn as (select *, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]|[\p{L}\p{N}]+|\S')) as n from un),
gr as (select *, least(coalesce(sum((n > 0)::int) over (partition by document_id order by i rows between unbounded preceding and 1 preceding), 0) + 1, sum((n > 0)::int) over (partition by document_id)) as k from cn),
se as (select document_id, k::bigint as k, sum(n)::bigint as n, string_agg(t, '' order by i) as t from gr group by document_id, k),
wh as (select document_id, sum(n) + 7 as whole from se group by document_id),
tk as (select se.*, whole, case when n > 593 then regexp_extract_all(t, '\s*(?:[\x{4e00}-\x{9fff}]|[\p{L}\p{N}]+|\S)') end as tok, regexp_extract(t, '\s*$') as rest from se join wh using (document_id)),
pc as (select document_id, k, q, n, t, tok, rest, least(n - q * 1993, 1993) as m from (select *, unnest(range(0, (n - 1) // 1993 + 1)) as q from tk)),
el as (select document_id, row_number() over (partition by document_id order by k, q, j) as k, j = 0 as opens, m > 593 as large, case when j = 0 then m else 0 end as pn, case when m > 593 then least(m - 520 * j, 593) else m end as cn,
 case when j > 0 then '' when n <= 593 then t else array_to_string(tok[q * 1993 + 1:q * 1993 + m], '') || case when q * 1993 + m = n then rest else '' end end as pt,
 case when n <= 593 then t else array_to_string(tok[q * 1993 + 520 * j + 1:q * 1993 + case when m > 593 then least(m, 520 * j + 593) else m end], '') || case when q * 1993 + case when m > 593 then least(m, 520 * j + 593) else m end = n then rest else '' end end as ct
 from (select *, unnest(range(0, case when m > 593 then 1 + (m - 593 + 519) // 520 else 1 end)) as j from pc)),
pk as (select document_id, k, 0::bigint as p, 7 + pn as hp, 0::bigint as c, 7 + cn as hc, large from el where k = 1
union all select document_id, k, case when np then p + 1 else p end, case when np then 7 + pn else hp + pn end, case when nc then c + 1 else c end, case when nc then 7 + cn else hc + cn end, large
from (select p, hp, c, hc, e.*, e.opens and whole > 2000 and (hp >= 1500 or hp + e.pn > 2000) as np, np or e.large or pk.large or (whole > 600 and (hc >= 450 or hc + e.cn > 600)) as nc from pk join el e on e.document_id = pk.document_id and e.k = pk.k + 1 join wh on wh.document_id = pk.document_id) x),
bd as (select pk.document_id, p, c, pk.k, pn, cn, pt, ct from pk join el using (document_id, k)),
ck as (select document_id, p, null::bigint as c, sum(pn) + 7 as size, string_agg(pt, '' order by k) as body from bd group by document_id, p union all select document_id, p, c, sum(cn) + 7, string_agg(ct, '' order by k) from bd group by document_id, p, c)
select document_id, 'v1' as version, case when c is null then 'p' || p else 'c' || c end as chunk_id, case when c is null then '' else 'p' || p end as parent_id, c is null as is_parent, 'text' as kind, body as body_text, 'doc-' || (document_id - 1) || '.txt' || chr(10) || chr(10) as context_prefix, size::int as token_count,
coalesce(lag(case when c is null then 'p' || p else 'c' || c end) over w, '') as prev_id, coalesce(lead(case when c is null then 'p' || p else 'c' || c end) over w, '') as next_id
from ck window w as (partition by document_id, c is null, case when c is null then -1 else p end order by p, c)"""


@query(CHUNKS_SQL)
def chunk_documents(spark, sf_dir) -> DataFrame:
    rows = chunking.chunk_rows(chunking.parse_and_chunk(documents(spark, sf_dir)))
    return rows.select("document_id", "version", "chunk_id", "parent_id", "is_parent", "data.kind", "data.body_text", "data.context_prefix", "data.token_count", "data.prev_id", "data.next_id")


@query()
def chunk_documents_bpe(spark, sf_dir) -> DataFrame:
    """All documents in chunks sized by a public byte-level BPE; tests compare them with chunks that are encoded at each probe."""
    import public_tokenizers

    rows = chunking.chunk_rows(chunking.parse_and_chunk(documents(spark, sf_dir), tokenizer=str(public_tokenizers.path("byte_bpe_50k.json"))))
    return rows.select("document_id", "version", "chunk_id", "parent_id", "is_parent", "data.body_text", "data.context_prefix", "data.token_count", "data.prev_id", "data.next_id")


@query("""with d as (select doc_id + 1 as id, text from documents where trim(coalesce(text, '')) <> '')
select id as document_id, unnest(case id % 7 when 1 then ['V4 chunk'] when 2 then ['V5 embedding text'] when 3 then ['V10 body'] when 4 then ['V11 document'] when 5 then ['V7 overlap'] when 6 then ['V3 ids'] else [] end) as rule, 1::bigint as count from d""")
def chunk_quality_report(spark, sf_dir) -> DataFrame:
    """What the validator finds in documents, six of seven with a fault put in, and in pages as they are."""
    d = chunking.parse_and_chunk(documents(spark, sf_dir))
    kind = F.col("document_id") % 7

    def changed(chunks: str, when, field: str, value):
        return F.transform(chunks, lambda c, i: F.when(when & (i == 0), c.withField(field, value(c))).otherwise(c))

    faulty = d.withColumn("children", changed("children", kind == 1, "token_count", lambda c: F.lit(601))).withColumn("children", changed("children", kind == 2, "embedding_text", lambda c: F.lit("x")))
    faulty = faulty.withColumn("parents", changed("parents", kind == 3, "body_text", lambda c: F.concat(c["body_text"], F.lit("!"))))
    faulty = faulty.withColumn("blocks", F.transform("blocks", lambda b: F.when(kind == 4, b.withField("reading_order", F.lit(7))).otherwise(b)))
    faulty = faulty.withColumn("children", changed("children", kind == 5, "overlap_spans", lambda c: c["source_spans"])).withColumn("children", changed("children", kind == 6, "chunk_id", lambda c: F.lit("no good")))
    # the chunk behind is linked to the name as it is now, so that the name is all that is wrong
    renamed = F.transform("children", lambda c, i: F.when((kind == 6) & (i == 1) & (c["prev_id"] != ""), c.withField("prev_id", F.lit("no good"))).otherwise(c))
    faulty = faulty.withColumn("children", renamed)
    return validation.report(faulty.where("error is null").union(chunking.parse_and_chunk(pages(spark, sf_dir))))


@query("select doc_id + 1 as document_id, text from documents where trim(coalesce(text, '')) <> ''")
def preview_text(spark, sf_dir) -> DataFrame:
    return chunking.preview(chunking.parse_and_chunk(documents(spark, sf_dir)).where("error is null"))


@query("""select o_custkey as parent, o_orderkey as chunk_id, coalesce('c' || lag(o_orderkey) over w, '') as prev_id, coalesce('c' || lead(o_orderkey) over w, '') as next_id from orders window w as (partition by o_custkey order by o_orderkey)""")
def prev_next_links(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    name = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    return roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("chunk_id"), F.lag(name, 1, "").over(w).alias("prev_id"), F.lead(name, 1, "").over(w).alias("next_id"))


@query("""with sp as (select l_orderkey as doc, (l_suppkey % 20)::int as start, (l_suppkey % 20 + l_linenumber * 5)::int as stop from lineitem),
g as (select doc, start, max(stop) over (partition by doc order by start, stop rows between unbounded preceding and 1 preceding) as reach from sp)
select doc, min(start) = 0 and not bool_or(coalesce(start > reach, false)) and (select max(stop) from sp s where s.doc = g.doc) >= 25 as covered from g group by doc""")
def span_coverage(spark, sf_dir) -> DataFrame:
    s = F.col("l_suppkey") % 20
    rows = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct(s.cast("int").alias("start"), (s + F.col("l_linenumber") * 5).cast("int").alias("end"))).alias("spans"))
    # how far the spans so far reach, and whether one begins beyond that: spans apart must not lie outside either
    start = F.struct(F.lit(0).alias("reach"), F.lit(False).alias("gap"))
    walk = F.aggregate(F.array_sort("spans"), start, lambda s, x: F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), (s["gap"] | (x["start"] > s["reach"])).alias("gap")))
    return rows.select("doc", (validation.covered(F.col("spans"), F.lit(0), F.lit(25)) & ~walk["gap"]).alias("covered"))


def pages_of_text(raw: bytes) -> Document:
    """A stand-in for a parser that is plugged in: what follows the signature, a page for each form feed."""
    out = Document()
    for number, text in enumerate(raw[8:].decode().split("\f"), 1):
        if text.strip():
            out.add("paragraph", text, number)
    return out


KINDS_SQL = """k as (select doc_id + 1 as document_id, doc_id % 6 as kind, coalesce(text, '') as text from documents)"""


@query(f"""with {KINDS_SQL} select document_id, case when kind = 1 then 'ValueError: a PDF file without its signature' when kind = 3 then 'ValueError: no parser for files of type xyz' when kind = 4 then 'ValueError: an archive that can''t be read: broken archive'
 when kind = 5 then 'ValueError: a document has too many pages' when trim(text) = '' then 'ValueError: a document has no chunks, or too many' end as error,
 case when kind in (0, 2) and trim(text) <> '' then 2 else 0 end::int as blocks, case when kind in (0, 2) and trim(text) <> '' then 2 end::int as last_page from k""")
def plugged_parsers(spark, sf_dir) -> DataFrame:
    """Files of kinds that have a parser plugged in, and files that no parser may see."""
    d, text = roles.table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 6
    name = F.concat(F.lit("f."), F.when(kind.isin(0, 1, 5), "pdf").when(kind == 2, "docx").when(kind == 3, "xyz").otherwise("docx"))
    twice = F.concat(text, F.lit("\f"), text)
    body = F.when(kind == 4, F.unhex(F.lit("504B0304"))).when(kind == 3, F.lit("x").cast("binary")).when(kind == 1, text.cast("binary")).when(kind == 2, F.concat(F.lit("DOCX 1.0"), twice).cast("binary")).when(kind == 5, F.concat(F.lit("%PDF-1.7"), F.repeat(F.lit("page\f"), 201)).cast("binary")).otherwise(F.concat(F.lit("%PDF-1.7"), twice).cast("binary"))
    # an empty file is refused before its kind is looked at
    body = F.when((kind == 1) & (text == ""), F.lit(" ").cast("binary")).otherwise(body)
    files = d.select((F.col("doc_id") + 1).alias("document_id"), name.alias("file_name"), body.alias("content"))
    parsed = chunking.parse_and_chunk(files, plugged={"pdf": pages_of_text, "office": pages_of_text}, max_chunks=10**6)
    last = F.array_max(F.transform(F.flatten(F.col("blocks.source_spans")), lambda s: s["page_no"]))
    return parsed.select("document_id", "error", F.size("blocks").alias("blocks"), last.alias("last_page"))


@query("""with li as (select l_orderkey as o, l_linenumber as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as r, l_partkey::varchar as part, l_quantity::int::varchar || ' \\| ' || l_linenumber as qty from lineitem),
rows_ as (select distinct o, 0 as row, 'line' as a, 'part' as b, 'amount | line' as c from li union all select o, r, n::varchar, part, replace(qty, '\\|', '|') from li),
cells as (select o, row, unnest([0, 1, 2])::int as col, [a, b, c] as v from rows_)
select o as document_id, 't0' as table_id, row::int as row, col as "column", v[col + 1] as text, row = 0 as header, (case col when 0 then 0 when 1 then length(v[1]) + 3 else length(v[1]) + length(v[2]) + 6 end)::int as start, ['Order ' || o] as heading from cells""")
def markdown_tables(spark, sf_dir) -> DataFrame:
    """An order's lines as a Markdown file with a table; its cells, with their places in the rows' blocks."""
    li = roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # parsing costs far more than the bytes of the lines say
    rows = li.repartition(parts(li), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("rows"))
    line = F.transform("rows", lambda r: F.concat(F.lit("| "), r["l_linenumber"].cast("string"), F.lit(" | "), r["l_partkey"].cast("string"), F.lit(" | "), r["l_quantity"].cast("int").cast("string"), F.lit(" \\| "), r["l_linenumber"].cast("string"), F.lit(" |")))
    text = F.concat(F.lit("# Order "), F.col("l_orderkey").cast("string"), F.lit("\n\nLines:\n\n| line | part | amount \\| line |\n| --- | :---: | --- |\n"), F.array_join(line, "\n"))
    cells = chunking.cell_rows(rows.select(F.col("l_orderkey").alias("document_id"), F.lit("order.md").alias("file_name"), text.cast("binary").alias("content")))
    return cells.select("document_id", "table_id", "row", "column", F.col("raw_text").alias("text"), F.col("column_header").alias("header"), "start", F.col("heading_path").alias("heading"))


@query("""with li as (select l_orderkey as o, l_linenumber as n, l_partkey::varchar as part, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem)
select o as document_id, 'row_group' as kind, [0, max(r) + 1]::int[] as row_range, 'table=t0; rows=0:' || max(r) + 1 || '; columns=0:2' || chr(10) || 'order.md / Order ' || o || chr(10) || chr(10) || 'line | part' || chr(10) ||
 string_agg('row ' || r || ': ' || n, chr(10) order by r) || chr(10) || chr(10) as context_prefix, 'line | part' || chr(10) || chr(10) || string_agg(n || ' | ' || part, chr(10) || chr(10) order by r) as body_text from li group by o""")
def table_chunks(spark, sf_dir) -> DataFrame:
    """Tables as parent chunks: rows and columns they cover, labels of columns and rows before their text."""
    li = roles.table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.col("l_partkey").cast("string"), F.lit(" |"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("# Order "), F.col("l_orderkey").cast("string"), F.lit("\n\n| line | part |\n| --- | --- |\n"), F.array_join(F.col("rows.line"), "\n"))
    chunks = chunking.chunk_rows(chunking.parse_and_chunk(rows.select(F.col("l_orderkey").alias("document_id"), F.lit("order.md").alias("file_name"), text.cast("binary").alias("content")), give=["parents", "children"]))
    return chunks.where("is_parent").select("document_id", "data.kind", "data.row_range", "data.context_prefix", "data.body_text")

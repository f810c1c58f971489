"""Named queries over element trees, look-ups, versions and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probe
from ..model import table
from ..operators import tree as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The markup tree by a stack of open elements that goes from token to token.
TREE_SQL = r"""with recursive p as (select page_id as file, coalesce(html, '') as html from pages),
    k as (select file, length(html) as n, regexp_extract_all(html, '(?s)<!--.*?-->|</?[a-zA-Z][a-zA-Z0-9]*[^>]*?/?>') as tok, string_split_regex(html, '(?s)<!--.*?-->|</?[a-zA-Z][a-zA-Z0-9]*[^>]*?/?>') as between from p),
    u as (select file, n, unnest(range(1, len(tok) + 1)) as j, tok, between from k),
    s as materialized (select file, n, tok[j] as t, (list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(tok[1:j - 1], lambda x: length(x))), 0))::bigint as pos, j from u),
    q as materialized (select file, n, row_number() over (partition by file order by j) as i, count(*) filter (t not like '</%') over (partition by file order by j) - 1 as node, pos, pos + length(t) as stop, t like '</%' as closing,
      lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag, t like '%/>' as single from s where t not like '<!--%'),
    r as (select file, 0::bigint as i, []::varchar[] as tags, []::bigint[] as nodes from p union all
      select file, i, case when not closing and (single or void) then up when not closing then list_append(up, tag) when hit = 0 then up else up[1:hit - 1] end,
        case when not closing and (single or void) then above when not closing then list_append(above, node) when hit = 0 then above else above[1:hit - 1] end
      from (select q.*, q.tag in ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') as void, r.tags as up, r.nodes as above,
        coalesce(list_max(list_filter(range(1, len(r.tags) + 1), lambda x: r.tags[x] = q.tag)), 0) as hit from r join q on q.file = r.file and q.i = r.i + 1) x),
    o as (select q.file, q.node, q.i, q.pos, q.stop, q.tag, q.n, b.tags as up, b.nodes as above, a.nodes as open_ from q join r b on b.file = q.file and b.i = q.i - 1 join r a on a.file = q.file and a.i = q.i where not q.closing),
    e as (select o.file, o.node, min(r.i) as ends from o join r on r.file = o.file and r.i > o.i and not list_contains(r.nodes, o.node) where list_contains(o.open_, o.node) group by o.file, o.node),
    tree as (select o.file, o.node::int as node, coalesce(o.above[-1], -1)::int as parent, (len(o.up) + 1)::int as depth, list_append(o.up, o.tag) as path, o.tag,
      o.pos as "offset", case when not list_contains(o.open_, o.node) then o.stop when e.ends is null then o.n when c.tag = o.tag and not list_contains(w.nodes, o.node) and len(w.nodes) = len(o.up) then c.stop else c.pos end - o.pos as size
      from o left join e on e.file = o.file and e.node = o.node left join q c on c.file = o.file and c.i = e.ends left join r w on w.file = o.file and w.i = e.ends)
    """


def pages(spark, d):
    return T.markup_tree(table(spark, d, "pages"))


@query("tree_paths", TREE_SQL + """select file, node, parent, depth, array_to_string(path, '.') as path, size from tree""")
def tree_paths(spark, d):
    return pages(spark, d).select("file", "node", "parent", "depth", F.array_join("path", ".").alias("path"), "size")


@query("tree_find_all", """select page_id as file, count(*) as articles from (select page_id, unnest(regexp_extract_all(html, '<article[ >]')) from pages) group by page_id""")
def tree_find_all(spark, d):
    return T.find_all(pages(spark, d), ["html", "body", None]).where("tag = 'article'").groupBy("file").agg(F.count("*").alias("articles"))


@query("tree_find_first", "select page_id as file, strpos(html, '<title>') - 1 as \"offset\" from pages where html like '%<title>%'")
def tree_find_first(spark, d):
    return T.find_first(pages(spark, d), ["html", "head", "title"]).select("file", "offset")


@query("tree_find_deep", "select page_id as file, len(regexp_extract_all(html, '<li>'))::bigint as items from pages where html like '%<li>%'")
def tree_find_deep(spark, d):
    return T.find_deep(pages(spark, d), "li").groupBy("file").agg(F.count("*").alias("items"))


@query("tree_has_path", "select page_id as file from pages where html like '%<footer>%'")
def tree_has_path(spark, d):
    return T.has_path(table(spark, d, "pages").select(F.col("page_id").alias("file")), pages(spark, d), ["html", "body", "footer"])


@query("tree_child_legality", TREE_SQL + """select path[-2] as parent_tag, tag, count(*) as n from tree where depth > 1 and path[-2] || '>' || tag not in
    ('html>head', 'html>body', 'head>meta', 'head>title', 'head>style', 'head>script', 'nav>ul', 'ul>li', 'li>a') group by all""")
def tree_child_legality(spark, d):
    tree = pages(spark, d)
    legal = tree.sparkSession.createDataFrame([("html", "head"), ("html", "body"), ("head", "meta"), ("head", "title"), ("head", "style"), ("head", "script"), ("nav", "ul"), ("ul", "li"), ("li", "a")], "outer string, inner string")
    return T.illegal_children(tree, legal).groupBy("parent_tag", "tag").agg(F.count("*").alias("n"))


@query("tree_hide_reveal", "select page_id as file, len(regexp_extract_all(html, '<p>'))::bigint as free, len(regexp_extract_all(html, '<p>'))::bigint as back from pages where html like '%<p>%'")
def tree_hide_reveal(spark, d):
    hidden = T.hide(pages(spark, d), ["p"])
    return T.reveal(hidden.withColumn("now", F.col("tag"))).where("tag = 'p'").groupBy("file").agg(F.count_if(F.col("now") == "free").alias("free"), F.count("*").alias("back"))


@query("tree_remove_children", TREE_SQL + "select tag, count(*) as n from tree where not list_has_any(path, ['nav', 'footer']) group by tag")
def tree_remove_children(spark, d):
    return T.remove_children(pages(spark, d), ["nav", "footer"]).groupBy("tag").agg(F.count("*").alias("n"))


@query("mapping_join", "select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def mapping_join(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(F.broadcast(regions), "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")


@query("pid_replace", "select l_orderkey, l_linenumber, l_partkey, l_suppkey as pid, coalesce(p_size::bigint, l_suppkey) as new_pid from lineitem left join part on p_partkey = l_suppkey and p_size < 25")
def pid_replace(spark, d):
    spec = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("long").alias("new_pid"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("pid"))
    return T.lookup(rows, "pid", spec, "new_pid")


@query("version_latest", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def version_latest(spark, d):
    return T.latest_version(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("version_undo", "select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 2")
def version_undo(spark, d):
    return T.latest_version(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 1).select("o_custkey", "o_orderkey", "o_orderstatus")


#: Heads of files by remainder, in hex.
HEADS = ["0000001866747970", "1A45DFA3", "464C5601", "89504E470D0A1A0A", "524946460000000057415645", "595556344D50454732", "FFFFFFFF"]


@query("probe_format", "select doc_id, ['mov', 'mkv', 'flv', 'png', 'wav', 'y4m', null][doc_id % 7 + 1] as format from documents")
def probe_format(spark, d):
    heads = F.array(*map(F.lit, HEADS))
    data = F.concat(F.unhex(F.get(heads, (F.col("doc_id") % 7).cast("int"))), F.encode(F.substring("text", 1, 600), "UTF-8"))  # a probe reads 600 bytes
    return table(spark, d, "documents").select("doc_id", probe.detect(data).alias("format"))

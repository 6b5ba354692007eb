"""The library's operators on the supplied tables, each beside its SQL.

Names give what is applied; the ids in brackets are those of the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, oracles
from .functions import text as t
from .operators import detect, options, select
from .plans import assemble
from .streaming.selection import select_many


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_extract_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[F1 F5 F6] Bodies of documents that are given front matter and a heading."""
    docs = table(spark, sf_dir, "documents")
    whole = F.concat(F.lit("---\ndescription: "), "lang", F.lit("\n---\n# "), "source", F.lit("\n\n"), "text")
    return docs.select("doc_id", t.extract_body(whole).alias("body"))


KEYWORDS = ["the", "und", "tion", "ein"]


def q_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P2 F2] Keywords that occur anywhere in a document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.keyword_hits(F.col("text"), KEYWORDS), ",").alias("hits"))


#: Marker files that event types stand for.
EVENT_MARKERS = {"purchase": "requirements.txt", "click": "package.json", "view": "Cargo.toml", "signup": "go.mod", "error": "pom.xml"}


def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file listing: folders of a few events, event types as marker files, properties as package.json."""
    name = catalog.lookup(EVENT_MARKERS, F.col("event_type"), F.lit("README"))
    folder = F.concat_ws("-", "user_id", F.col("event_id") % 97)
    return table(spark, sf_dir, "events").select(
        F.lit("").alias("root"), F.lit("").alias("parent"), folder.alias("folder"), name.alias("name"),
        F.when(name == "package.json", F.concat(F.lit('{"dependencies": '), "props", F.lit("}"))).alias("content"),
    )


def q_detect_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A3 S3] The language of each folder by its highest marker."""
    return detect.folder_technology(event_listing(spark, sf_dir)).select("folder", "language")


def q_dep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P3 S4 U3] Dependency keys of a package file, and whether one is present."""
    keys = detect.dependency_keys(F.concat(F.lit('{"dependencies": '), "props", F.lit(', "devDependencies": {"react": "1"}}')))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(F.array_sort(keys), ",").alias("dep_keys"), F.array_contains(keys, "k").alias("has_k")
    )


LANG_EXT = {"en": "md", "de": "{txt,md}"}


def q_glob_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J6 F10] A glob for each document, by a left join with a default."""
    ext = spark.createDataFrame(list(LANG_EXT.items()), "lang string, ext string")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(ext), "lang", "left")
    return docs.select("doc_id", F.concat("source", F.lit("/**/*."), F.coalesce("ext", F.lit("*"))).alias("glob"))


def q_anti_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J4 U5] Documents that have no label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def q_ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A6 A4] Each user's distinct event types in the order they were first seen."""
    seen = select.first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    rows = seen.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("text"))
    return assemble.fold(rows, "user_id", ",").withColumnRenamed("content", "types")


def q_per_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[W2 W1] The first three turns of each conversation."""
    return select.first_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")


def q_union_all_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[U2 A4 T12] A document for each conversation: a heading, then its turns in order."""
    turns = table(spark, sf_dir, "conversations")
    head = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("# Conversation "), "conv_id").alias("text"))
    body = turns.select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("- "), "role", F.lit(": "), "text").alias("text"))
    return assemble.fold(head.unionByName(body), "conv_id", "\n").withColumnRenamed("content", "doc")


SEARCHED = "ring"


def q_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P1 L1] The options displayed for a search."""
    found = options.search(table(spark, sf_dir, "part"), "p_name", SEARCHED)
    return options.shown(found, "p_partkey").select("p_partkey", "p_name")


def q_head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[L2 L3 L4 L5 L6] Documents cut to so many lines, with and without a marker."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.head_lines(F.col("text"), 5, "\n[... truncated ...]").alias("head5"), t.head_lines(F.col("text"), 40).alias("head40")
    )


def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with all but their end hidden."""
    return table(spark, sf_dir, "events").select("event_id", t.mask(F.col("event_type")).alias("masked"))


def q_numeric_sel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[L9 F13 A7] The option of a number, within bounds."""
    offered = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit("option "), i.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", options.pick(offered, F.col("p_size").cast("string")).alias("picked"))


def q_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A2 F12] Characters and lines of each document."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), t.line_count(c).cast("long").alias("lines"))


def q_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[F3 F4] Names in title case, hyphens as spaces."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", t.title(name).alias("hyphened"), t.spaced_title(name).alias("spaced"))


def q_replace_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that holds a token, replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", t.rewrite_lines(F.col("text"), "Licen", "alwaysApply: true").alias("body"))


def q_line_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A1] Documents per language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[U1 U4 J7 A5] Union, difference and intersection of small ordered lists."""
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("united"),
        F.array_join(options.remaining(b, a), ",").alias("remaining"),
        F.array_join(options.kept_defaults(b, a), ",").alias("kept"),
    )


#: Not all event types, so that some requests are unknown.
KNOWN = list(EVENT_MARKERS)[:-2]


def q_semi_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P9 P10 S3] Known names that are requested, and requested ones that are unknown."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct()
    known = spark.createDataFrame(list(enumerate(KNOWN)), "pos int, key string")
    good = options.enabled(known, asked).select("key", F.lit(True).alias("known"))
    return good.unionByName(options.unknown(asked, known, "key").select("key", F.lit(False).alias("known")))


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests, for documents of many projects at once."""
    langs, fws = F.array(*map(F.lit, catalog.PRIMARY)), F.array(F.lit("fastapi"), F.lit("react"), F.lit("Database"))
    k = F.col("p_partkey").cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("request_id"), F.col("p_name").alias("description"), (k % 2 == 0).alias("is_monorepo"),
        F.get(langs, k % len(catalog.PRIMARY)).alias("primary_language"), F.slice(fws, 1, k % 4).alias("frameworks"),
        F.lit(".cursorrules").alias("output_file"), F.lit(None).cast("string").alias("project_root"),
    )


#: A small corpus of the names that requests ask for.
CORPUS = [
    *((n, 1, f"---\ndescription: {n}\n---\n\n# {n}\n\n" + "\n".join(f"- rule {i} of {n}" for i in range(3 + 30 * k))) for k, n in enumerate(["python", "typescript", "rust", "cpp", "react", *catalog.UNIVERSAL])),
    ("python-fastapi-best", 2, "# tier two\nfound by name"),
]


def corpus_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS, "rule_name string, tier int, content string")


def q_rule_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J1 J2 J3 J9 S1 W2] Rules chosen for each request, in order, with the length of their bodies."""
    names = requests_of(spark, sf_dir).select("request_id", select.folder_rule_names(F.col("primary_language"), F.col("frameworks")).alias("names"))
    got = select.with_contents(names, corpus_of(spark), chars=F.length(t.extract_body(F.col("content"))).cast("long"))
    return got.select("request_id", "ord", "rule_name", "chars")


def q_single_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T1 T9 T10 T11 J1 J3 J4 A4] The whole document of every request."""
    made = assemble.single_project(requests_of(spark, sf_dir), corpus_of(spark))
    return made.select("request_id", F.sha2("content", 256).alias("digest"), t.line_count(F.col("content")).alias("lines"))


def q_tool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T6 T7 T15 K5 J8] Every tool's files for every request."""
    return assemble.tool_files(requests_of(spark, sf_dir)).select("request_id", "path", F.sha2("content", 256).alias("digest"))


def q_shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[K2 T5] The shared directory of every request."""
    return assemble.shared_files(requests_of(spark, sf_dir), corpus_of(spark)).select("request_id", "path", F.sha2("content", 256).alias("digest"))


def q_folder_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T2 T3 T13 L5 L6 F20 F22] Rule documents of the folders that events stand for."""
    found = detect.folder_technology(event_listing(spark, sf_dir)).where("language IS NOT NULL")
    packages = found.select(F.col("folder").alias("package_id"), F.concat(F.lit("apps/"), "folder").alias("folder_path"), F.col("folder").alias("folder_name"), "language", "frameworks")
    made = assemble.with_folder_rules(packages, corpus_of(spark)).withColumn("agents", assemble.agents_content())
    return made.select(
        "package_id", t.line_count(F.col("content")).alias("rule_lines"), t.line_count(F.col("agents")).alias("agents_lines"), F.sha2(F.concat("content", "agents"), 256).alias("digest")
    )


def q_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[W1 L1] The options displayed, numbered."""
    return options.numbered(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "number")


#: Front matter of every other document.
FRONT = "---\ndescription: old\nglobs:\n  - old/**\n---\n"


def q_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[F20 F22] Documents whose front matter gets a new glob, or that get front matter."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, FRONT).otherwise(""), "text")
    return docs.select("doc_id", F.sha2(assemble.proper_front_matter(content, F.col("source"), F.lit("src/**/*.py")), 256).alias("digest"))


def q_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T8 L4] The prompt for every request."""
    asked = requests_of(spark, sf_dir).select(
        "request_id", F.lit("Be brief.").alias("general_guidelines"), F.col("description").alias("project_context"), F.lit("project").alias("rule_type"),
        F.col("is_monorepo").alias("format_mdc"), select.folder_rule_names(F.col("primary_language"), F.col("frameworks")).alias("names"),
    )
    return assemble.prompts(asked, corpus_of(spark)).select("request_id", F.sha2("prompt", 256).alias("digest"))


#: Roots that parts stand for packages of.
ROOTS = 40


def q_monorepo_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[T4 T12 K3] The root document of each monorepo, with parts as packages."""
    asked = requests_of(spark, sf_dir).withColumn("project_root", F.concat(F.lit("r"), F.col("request_id").cast("int") % ROOTS))
    packages = asked.select(
        F.col("project_root").alias("root"), (F.col("request_id").cast("int") % 3).alias("place"), F.concat(F.lit("pkg-"), "request_id").alias("folder_name"),
        F.col("primary_language").alias("language"), "frameworks",
    )
    made = assemble.monorepo_root(asked.where(F.col("request_id").cast("int") < ROOTS), packages, True)
    return made.select("request_id", F.sha2("content", 256).alias("digest"))


def q_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[F7 F8 F11 F16 F17 F18 F19 L7] Small text functions, on parts."""
    name, words = F.col("p_name"), F.split("p_name", " ")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/srv/app/"), "p_name")).otherwise(F.concat(F.lit("/opt\\"), "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.before_glob(F.concat("p_brand", F.lit("/**/*."), "p_name")).alias("folder"),
        F.array_join(t.comma_split(F.concat(name, F.lit(" , "), "p_brand", F.lit(" ,x"))), "|").alias("listed"),
        t.joined_or(F.filter(words, lambda w: F.length(w) > 4), "None").alias("long_words"), t.yes_no(F.col("p_size") > 25).alias("large"),
        t.true_false(F.col("p_size") > 25).alias("flag"), t.parse_flag(F.concat(F.lit(" "), F.get(F.array(F.lit("Yes"), F.lit("no"), F.lit("1 ")), (F.col("p_partkey") % 3).cast("int")))).alias("parsed"),
        t.relative(path, F.lit("/srv/app/"), F.lit("outside")).alias("below"),
        options.selected_summary(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: F.concat(F.lit("opt-"), i.cast("string"))), 3).alias("summary"),
    )


#: What is typed in the dialogues: numbers in and out of bounds, commands, nothing, and words that one, several or no options hold.
ANSWERS = ["3", "java", "done", "26", "", "clear", "scal", "zz", "1"]


def q_selection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X1 U4 L8] The multiple-choice dialogue, with each conversation's turns as answers."""
    word = F.get(F.array(*map(F.lit, ANSWERS)), ((F.length("text") + F.col("turn")) % len(ANSWERS)).cast("int"))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", word.alias("word"))
    typed = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "word"))), lambda x: x.word).alias("typed"))
    offered, first = F.array(*map(F.lit, catalog.PRIMARY)), F.array(F.lit("rust"))
    s = typed.select("conv_id", select_many(offered, first, F.col("typed")).alias("s"))
    return s.select("conv_id", F.array_join("s.selected", ",").alias("selected"), "s.done")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q_extract_body, q_keyword_scan, q_detect_priority, q_dep_map, q_glob_left_join, q_anti_universal, q_ordered_dedup, q_per_group_limit,
        q_union_all_sections, q_search_topk, q_head_lines, q_mask, q_numeric_sel, q_doc_stats, q_title, q_replace_line, q_line_count_by_lang,
        q_set_ops, q_semi_validation, q_rule_selection, q_single_project, q_tool_files, q_shared_files, q_folder_rules, q_selection_fold,
        q_numbered, q_front_matter, q_prompt, q_monorepo_root, q_scalars,
    )
}

_MARK = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {p}" for p, k in enumerate(EVENT_MARKERS, 1)) + " END"
_LANGS = {1: "python", 2: "javascript", 3: "rust", 4: "go", 5: "java"}
_strip, _TITLE = oracles.strip, oracles.TITLE


def _head(n: int, marker: str) -> str:
    lines = "string_split(text, chr(10))"
    return f"CASE WHEN len({lines}) > {n} THEN array_to_string({lines}[1:{n}], chr(10)) || {marker} ELSE text END"


ORACLES: dict[str, str] = {
    "q_extract_body": f"""
        WITH w AS (SELECT doc_id, string_split('---' || chr(10) || 'description: ' || lang || chr(10) || '---' || chr(10) || '# ' || source || chr(10) || chr(10) || text, chr(10)) AS l FROM documents),
        p AS (SELECT doc_id, l, coalesce(list_position(list_transform(l[2:], lambda x: {_strip("x")}), '---'), 0) AS k FROM w),
        c AS (SELECT doc_id, {_strip("array_to_string(l[k + 2:], chr(10))")} AS b FROM p)
        SELECT doc_id, CASE WHEN b[1] = '#' THEN {_strip("array_to_string(string_split(b, chr(10))[2:], chr(10))")} ELSE b END AS body FROM c""",
    "q_keyword_scan": "SELECT doc_id, array_to_string(list_filter(" + str(KEYWORDS) + ", lambda k: contains(lower(text), k)), ',') AS hits FROM documents",
    "q_detect_priority": f"""
        SELECT user_id || '-' || (event_id % 97) AS folder, CASE min({_MARK}) {" ".join(f"WHEN {p} THEN '{v}'" for p, v in _LANGS.items())} END AS language
        FROM events GROUP BY 1""",
    "q_dep_map": """
        SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(json_keys(props), ['react']))), ',') AS dep_keys,
               list_contains(json_keys(props), 'k') AS has_k FROM events""",
    "q_glob_left_join": "SELECT doc_id, source || '/**/*.' || coalesce(e.ext, '*') AS glob FROM documents d LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LANG_EXT.items()) + ") e(lang, ext) ON d.lang = e.lang",
    "q_anti_universal": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q_ordered_dedup": "SELECT user_id, string_agg(event_type, ',' ORDER BY e) AS types FROM (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2) GROUP BY 1",
    "q_per_group_limit": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
    "q_union_all_sections": "SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg('- ' || role || ': ' || text, chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY 1",
    "q_search_topk": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '" + SEARCHED + "') ORDER BY p_partkey LIMIT 25",
    "q_head_lines": f"""SELECT doc_id, {_head(5, "chr(10) || '[... truncated ...]'")} AS head5, {_head(40, "''")} AS head40 FROM documents""",
    "q_mask": "SELECT event_id, CASE WHEN length(event_type) < 8 THEN '****' ELSE repeat('*', 10) || right(event_type, 4) END AS masked FROM events",
    "q_numeric_sel": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 25 THEN 'option ' || p_size END AS picked FROM part",
    "q_doc_stats": "SELECT doc_id, length(text)::BIGINT AS chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END::BIGINT AS lines FROM documents",
    "q_title": f"SELECT p_partkey, {_TITLE.format("replace(p_name, ' ', '-')")} AS hyphened, replace({_TITLE.format("replace(p_name, ' ', '-')")}, '-', ' ') AS spaced FROM part",
    "q_replace_line": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, 'Licen') THEN 'alwaysApply: true' ELSE x END), chr(10)) AS body FROM documents",
    "q_line_count_by_lang": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "q_set_ops": """
        WITH s AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS united,
               array_to_string(list_filter(b, lambda x, i: NOT list_contains(a, x) AND list_position(b, x) = i), ',') AS remaining,
               array_to_string(list_filter(b, lambda x, i: list_contains(a, x) AND list_position(b, x) = i), ',') AS kept FROM s""",
    "q_semi_validation": "SELECT DISTINCT event_type AS key, event_type IN (" + ", ".join(f"'{k}'" for k in KNOWN) + ") AS known FROM events",
    "q_rule_selection": oracles.rule_selection(CORPUS),
    "q_single_project": oracles.single_project(CORPUS),
    "q_tool_files": oracles.tool_files(),
    "q_shared_files": oracles.shared_files(CORPUS),
    "q_selection_fold": oracles.selection_fold(ANSWERS, "rust"),
    "q_numbered": "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey)::INTEGER AS number FROM part ORDER BY p_partkey LIMIT 25",
    "q_front_matter": oracles.front_matter(FRONT, "src/**/*.py"),
    "q_prompt": oracles.prompt(CORPUS),
    "q_monorepo_root": oracles.monorepo_root(ROOTS),
    "q_scalars": oracles.SCALARS,
}

"""Queries for operators at scale and for branches that few rows reach, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, oracles
from .functions import text as t
from .operators import answers, detect, keywords, select
from .plans import assemble
from .plans import fixed_texts as fixed
from .queries import ANSWERS, CORPUS, ORACLES as PLAIN, corpus_of, requests_of, table
from .session import shared_dir
from .streaming import dialogue


def q_hot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[A4] All events of a type as one document, in order: few keys with very many sections."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("ord"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "props").alias("text"))
    return assemble.fold(rows, "event_type", "\n").select("event_type", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("digest"))


def q_substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[J9] For pieces of part names, of one to six characters, the first name that contains each."""
    parts = table(spark, sf_dir, "part")
    piece = F.col("p_name").substr((F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_partkey") % 6 + 1).cast("int"))
    names = parts.select(piece.alias("rule_name")).union(parts.select(F.concat("p_brand", F.lit(" ")).alias("rule_name"))).distinct()
    return select.first_holding(names, parts.select(F.col("p_name").alias("entry"), F.col("p_type").alias("found")))


def q_keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[P2] Which of all the words of the benchmark occur in each document."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[ \n]")).alias("keyword")).where("keyword <> ''").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = keywords.keyword_matches(docs, words.withColumn("pos", F.col("keyword")), F.col("text"))
    return got.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.sha2(F.array_join("hits", " "), 256).alias("digest"))


#: The stream's portions of a conversation, by turn.
PORTIONS = ((None, 1), (1, 3), (3, None))


def q_selection_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[X1] The multiple-choice dialogue as a stream: turns come in three portions, each taken by a new start on one checkpoint."""
    at = f"{shared_dir(spark)}/dialogue-{uuid.uuid4().hex}"
    word = F.get(F.array(*map(F.lit, ANSWERS)), ((F.length("text") + F.col("turn")) % len(ANSWERS)).cast("int"))
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word.alias("word"))
    for lo, hi in PORTIONS:
        part = said.where((F.lit(lo is None) | (F.col("turn") >= F.lit(lo))) & (F.lit(hi is None) | (F.col("turn") < F.lit(hi))))
        part.write.mode("append").parquet(f"{at}/came")
        dialogue.run_available(spark, f"{at}/came", f"{at}/out", catalog.PRIMARY, ["rust"])
    return dialogue.latest(spark, f"{at}/out").select("conv_id", F.array_join("selected", ",").alias("selected"), "done")


def stand_in(prompt: str) -> str | None:
    """What stands for an outside model: it answers with the prompt's size, and long prompts not at all."""
    return f"answered {len(prompt)}" if len(prompt) % 3 else None


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[D1 S11 P8] Answers of a completion for every request, by way of the answer table, or else the description."""
    asked = requests_of(spark, sf_dir)
    prompts = asked.select("request_id", F.concat_ws(" for ", "primary_language", F.substring("description", 1, 5)).alias("prompt"))
    got = answers.answer_once(prompts, stand_in, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")
    template = asked.select("request_id", F.col("description").alias("content"))
    return assemble.or_template(got, template)


#: Front matter with an empty list, with a list, and none that opens a list.
FRONTS = ["---\nglobs:\n---\n", "---\nglobs: x\n  - a\n  - b\n---\n", "---\ndescription: d\n---\n"]


def q_glob_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs rewritten in documents with bullets in their body, and lists that are missing or open twice."""
    docs = table(spark, sf_dir, "documents")
    body = F.regexp_replace(F.regexp_replace("text", r"\. ", "\n- "), ", ", "\nglobs: ")
    content = F.concat(F.get(F.array(*map(F.lit, FRONTS)), (F.col("doc_id") % 3).cast("int")), body)
    return docs.select("doc_id", F.sha2(t.rewrite_glob(content, F.lit("src/**")), 256).alias("digest"))


def q_line_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[L3 L4 L5 L6] Each source's documents end to end, up to 150 lines: what is beyond is never joined."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.concat(F.regexp_replace("text", r"\. ", "\n"), F.lit("\n")).alias("text"))
    made = assemble.fold(assemble.within_lines(rows, "source", 150), "source")
    return made.select("source", F.sha2(t.head_lines(F.col("content"), 150, "\n[... truncated ...]"), 256).alias("digest"))


#: What ends lines here, besides \n.
ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]


def q_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with every kind of line end, at the end too."""
    docs = table(spark, sf_dir, "documents")
    end = F.get(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % len(ENDS)).cast("int"))
    text = F.concat(F.replace("text", F.lit(", "), end), F.when(F.col("doc_id") % 2 == 0, end).otherwise(""))
    return docs.select("doc_id", t.line_count(text).cast("long").alias("lines"))


#: Languages as they may be typed.
TYPED = ["js", "TS", "ts", "JavaScript", "python", "PHP", "cobol", "rust", ""]


def q_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[F19 P7 P11 P12] What the catalog says of languages as typed."""
    parts = table(spark, sf_dir, "part").withColumn("typed", F.get(F.array(*map(F.lit, TYPED)), (F.col("p_partkey") % len(TYPED)).cast("int")))
    typed = F.col("typed")
    return parts.select(
        "p_partkey", catalog.language_key(typed).alias("language"), catalog.rule_name(typed).alias("rule_name"), F.array_join(catalog.additional_rules(typed), ",").alias("additional"),
        F.array_join(catalog.available_frameworks(typed), ",").alias("offered"), F.array_position(F.array(*map(F.lit, catalog.PRIMARY)), catalog.language_key(typed)).cast("int").alias("place"),
    )


#: Package files: whole, broken, null, of other kinds, with parts that aren't objects.
PACKAGE_FILES = [
    '{"dependencies": {"react": "1", "next": "2"}, "devDependencies": {"typescript": "5"}}', '{"dependencies": {"react": ', "null", "[1, 2]", '{"dependencies": {"vue": "3"}, "devDependencies": null}',
    '{"devDependencies": {"sveltekit": "1", "svelte": "4", "express": "4"}}', "{}", '{"dependencies": {"k": null}}',
]
PARENTS = ["packages", "apps", "", "other"]
FOLDERS = [".hidden", "node_modules", "web", "api", "core"]
FILES = ["package.json", "requirements.txt", "tsconfig.json", "Cargo.toml", "pom.xml", "README"]


def package_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of many roots: a third of the roots have folders of their own only."""
    def pick(xs, c):
        return F.get(F.array(*map(F.lit, xs)), c.cast("int"))

    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id"))
    parent = F.when(F.col("user_id") % 3 == 0, "").otherwise(pick(PARENTS, F.col("k") % 4))
    name = pick(FILES, F.floor(F.col("k") / 4) % len(FILES))
    folder = pick(FOLDERS, F.floor(F.col("k") / 24) % len(FOLDERS))
    content = F.when(name == "package.json", pick(PACKAGE_FILES, F.floor(F.col("k") / 7) % len(PACKAGE_FILES))).when(name == "requirements.txt", F.concat(F.lit("Flask\n"), "event_type", F.lit("django")))
    return e.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("root"), parent.alias("parent"), F.when(parent == "", folder).otherwise(F.concat(parent, F.lit("/"), folder)).alias("folder"), name.alias("name"), content.alias("content"),
    )


def q_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[S3 S4 S6 P4 P6 J5] Packages of every root, with languages, frameworks and warnings; malformed files among them."""
    return detect.discover_packages(package_listing(spark, sf_dir)).select("root", "place", "folder_path", "folder_name", "language", F.array_join("frameworks", ",").alias("frameworks"), "warning")


def q_monorepo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[K3 K4 T2 T3 T4 T13 T14] All files of monorepos whose packages are found in listings."""
    packages = detect.discover_packages(package_listing(spark, sf_dir))
    roots = packages.select("root").distinct()
    asked = roots.select(
        F.col("root").alias("request_id"), F.concat(F.lit("The "), "root").alias("description"), F.lit(True).alias("is_monorepo"), F.lit("python").alias("primary_language"),
        F.array(F.lit("fastapi")).alias("frameworks"), F.lit("").alias("output_file"), F.col("root").alias("project_root"),
    )
    return assemble.monorepo_files(asked, packages, corpus_of(spark)).select("request_id", "path", F.sha2("content", 256).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q_hot_fold, q_substring_join, q_keyword_table, q_selection_stream, q_answers, q_glob_rewrite, q_line_budget, q_line_ends, q_aliases, q_packages, q_monorepo_files,
    )
}

_q, _NL = oracles.quoted, "chr(10)"


def _listed(xs: list[str]) -> str:
    return oracles.listed(xs)


def _chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def folder_documents(source: str) -> str:
    """content and agents of each row of ``source(package_id, folder_path, folder_name, language, fws)``; needs ``found(rule_name, body)``."""
    title, spaced = oracles.TITLE, oracles.spaced
    stack = f"""'## Technology Stack' || {_NL} || '- Language: ' || {title.format("language")} || {_NL}
      || CASE WHEN len(fws) > 0 THEN '- Frameworks: ' || array_to_string(list_transform(fws, lambda f: {spaced("f")}), ', ') || {_NL} ELSE '' END || {_NL}"""
    head = f"""'# ' || {title.format("folder_name")} || ' Package' || {_NL} || {_NL} || 'This folder contains the **' || folder_name || '** package"""
    front = f"""'---' || {_NL} || 'description: ' || {title.format("folder_name")} || ' package-specific rules' || {_NL} || 'globs:' || {_NL} || '  - "' || folder_path || '/**/*.' || {oracles.chosen(catalog.FOLDER_EXTENSIONS, "language", "'*'")}
      || '"' || {_NL} || 'alwaysApply: false' || {_NL} || '---' || {_NL} || {_NL}"""

    def cut(c: str, n: int, marker: str = "''") -> str:
        return f"CASE WHEN len(string_split({c}, {_NL})) > {n} THEN array_to_string(string_split({c}, {_NL})[1:{n}], {_NL}) || {marker} ELSE {c} END"

    long = cut("body", 100, _q("\n\n[... additional rules apply from general guidelines ...]"))
    short = cut("body", 80, _q("\n\n[... truncated for brevity ...]"))
    commands = oracles.chosen({k: "".join(c + "\n" for c in v) for k, v in catalog.COMMANDS.items()}, "language", "''")
    listed = oracles.chosen({k: "\n".join(v) + "\n" for k, v in fixed.AGENTS_COMMANDS.items()}, "language", "''")
    notes = oracles.chosen({k: "\n".join(v) + "\n" for k, v in fixed.AGENTS_NOTES.items()}, "language", "''")
    return f"""src AS ({source}),
    asks AS (SELECT package_id, 10 AS ord, {oracles.chosen(oracles.RULES, "language")} AS rule_name, {title.format("language")} AS heading, true AS own FROM src
      UNION ALL SELECT package_id, 20 + i, lower(f), {spaced("f")}, false FROM (SELECT package_id, unnest(fws[1:2]) AS f, unnest(range(least(len(fws), 2))) AS i FROM src)),
    told AS (SELECT package_id, string_agg(CASE WHEN own THEN '## ' || heading || ' Best Practices' || {_NL} || {_NL} || ({long}) ELSE '## ' || heading || ' Patterns' || {_NL} || {_NL} || ({short}) END || {_NL} || {_NL}, '' ORDER BY ord) AS rules
      FROM asks JOIN found USING (rule_name) GROUP BY 1),
    whole AS (SELECT src.*, {front} || {head}.' || {_NL} || {_NL} || {stack} || coalesce(rules, '') || '## Commands' || {_NL} || {commands} || {_NL} || {_q(fixed.GOTCHAS)} AS c,
      {head} implementation.' || {_NL} || {_NL} || {stack} || '## Commands' || {_NL} || {listed} || {_NL} || {_q(chr(10).join(fixed.AGENTS_PATTERNS) + chr(10))} || {notes} AS a FROM src LEFT JOIN told USING (package_id)),
    made AS (SELECT package_id, folder_path, folder_name, {cut("c", 150)} AS content, {cut("b", 80)} AS agents FROM (SELECT *, CASE WHEN right(a, 1) = {_NL} THEN left(a, length(a) - 1) ELSE a END AS b FROM whole))"""


def _listing() -> str:
    def pick(xs, c):
        return f"{_listed(xs)}[({c})::INTEGER + 1]"

    return f"""e AS (SELECT user_id, event_id AS k, event_type, CASE WHEN user_id % 3 = 0 THEN '' ELSE {pick(PARENTS, "event_id % 4")} END AS parent, {pick(FILES, f"event_id // 4 % {len(FILES)}")} AS name,
      {pick(FOLDERS, f"event_id // 24 % {len(FOLDERS)}")} AS own FROM events),
    l AS (SELECT 'r' || user_id AS root, parent, CASE WHEN parent = '' THEN own ELSE parent || '/' || own END AS folder, name,
      CASE name WHEN 'package.json' THEN {pick(PACKAGE_FILES, f"k // 7 % {len(PACKAGE_FILES)}")} WHEN 'requirements.txt' THEN 'Flask' || {_NL} || event_type || 'django' END AS content FROM e),
    g AS (SELECT root, parent, folder, bool_or(name = 'package.json') AS js, bool_or(name = 'requirements.txt') AS py, bool_or(name = 'tsconfig.json') AS ts, bool_or(name = 'Cargo.toml') AS rs, bool_or(name = 'pom.xml') AS jv,
      max(content) FILTER (name = 'package.json') AS pkg, max(content) FILTER (name = 'requirements.txt') AS req FROM l GROUP BY 1, 2, 3),
    d AS (SELECT *, js AND NOT json_valid(pkg) AS bad, CASE WHEN json_valid(pkg) THEN list_concat(
        CASE WHEN json_type(pkg, '$.dependencies') = 'OBJECT' THEN json_keys(pkg, '$.dependencies') ELSE CAST([] AS VARCHAR[]) END,
        CASE WHEN json_type(pkg, '$.devDependencies') = 'OBJECT' THEN json_keys(pkg, '$.devDependencies') ELSE CAST([] AS VARCHAR[]) END) ELSE CAST([] AS VARCHAR[]) END AS deps FROM g),
    t AS (SELECT *, CASE WHEN py THEN 'python' WHEN js THEN CASE WHEN NOT bad AND (ts OR list_contains(deps, 'typescript')) THEN 'typescript' ELSE 'javascript' END WHEN rs THEN 'rust' WHEN jv THEN 'java' END AS language FROM d),
    f AS (SELECT *, CASE WHEN py THEN list_filter({_listed(catalog.PYTHON_KEYWORDS)}, lambda w: contains(lower(req), w)) WHEN js AND NOT bad THEN
        list_transform(list_filter({_listed([d for d, _ in catalog.NPM])}, lambda w: list_contains(deps, w)), lambda w: {oracles.chosen(dict(catalog.NPM), "w")}) ELSE CAST([] AS VARCHAR[]) END AS fws0,
        string_split(folder, '/')[-1] AS folder_name, list_position({_listed(catalog.PACKAGE_DIRS)}, parent)::INTEGER AS p FROM t WHERE language IS NOT NULL),
    v AS (SELECT *, coalesce(p, 0) AS place, list_filter(fws0, lambda w, i: list_position(fws0, w) = i) AS fws FROM f
      WHERE folder_name NOT LIKE '.%' AND (p > 0 OR (parent = '' AND NOT list_contains({_listed(catalog.SKIPPED_DIRS)}, folder_name)))),
    pk AS (SELECT root, place, folder AS folder_path, folder_name, language, fws, CASE WHEN bad AND language = 'javascript' THEN 'package.json could not be parsed' END AS warning,
      max(place > 0) OVER (PARTITION BY root) AS standard FROM v),
    packages AS (SELECT * FROM pk WHERE (place > 0) = standard)"""


def _monorepo() -> str:
    navigation = fixed.NAVIGATION.replace("{last}", fixed.NAVIGATION_MONOREPO)
    title, spaced = oracles.TITLE, oracles.spaced
    context = oracles.CONTEXT
    rest = f"""'# Monorepo AI Coding Rules' || {context} || {_q(fixed.GENERAL_PRINCIPLES)} || {_q(fixed.MONOREPO_STRUCTURE)} || listed || {_q(navigation)} || {_q(fixed.CRITICAL)}"""
    listing = "## Package-Specific Rules\n\nEach package has its own rules. When working in a package, refer to:\n\n"
    source = "SELECT root || '/' || folder_path AS package_id, folder_path, folder_name, language, fws FROM packages"
    return f"""WITH {_listing()}, {oracles.bodies(CORPUS)}, {folder_documents(source)},
    owner AS (SELECT DISTINCT root, root || '/' || folder_path AS package_id FROM packages),
    lines AS (SELECT root, {_q(listing)} || string_agg('- **' || folder_name || '/**: ' || {title.format("language")} || CASE WHEN len(fws) > 0 THEN ' with ' || array_to_string(list_transform(fws[1:2], lambda f: {spaced("f")}), ', ') ELSE '' END
      || {_NL} || '  - See `' || folder_name || '/.cursor/rules/` for Cursor rules' || {_NL} || '  - See `' || folder_name || '/AGENTS.md` for cross-tool rules', {_NL} ORDER BY place, folder_name) || {_NL} AS listed FROM packages GROUP BY 1),
    roots AS (SELECT root, 'The ' || root AS description, 'python' AS lang, ['fastapi'] AS fws, true AS mono, listed FROM lines)
    SELECT root AS request_id, '.cursor/rules/security.mdc' AS path, sha256({_q(fixed.SECURITY)}) AS digest FROM roots
    UNION ALL SELECT root, '.cursor/rules/general.mdc', sha256({_q("".join(fixed.MONOREPO_FRONTMATTER))} || {rest}) FROM roots
    UNION ALL SELECT root, 'CLAUDE.md', sha256({rest}) FROM roots
    UNION ALL SELECT root, folder_path || '/.cursor/rules/' || folder_name || '-patterns.mdc', sha256(content) FROM made JOIN owner USING (package_id)
    UNION ALL SELECT root, folder_path || f, sha256(agents) FROM made JOIN owner USING (package_id), (VALUES ('/AGENTS.md'), ('/CLAUDE.md')) x(f)"""


def _folder_rules() -> str:
    mark = PLAIN["q_detect_priority"]
    source = "SELECT folder AS package_id, 'apps/' || folder AS folder_path, folder AS folder_name, language, CAST([] AS VARCHAR[]) AS fws FROM marked WHERE language IS NOT NULL"
    return f"""WITH marked AS ({mark}), {oracles.bodies(CORPUS)}, {folder_documents(source)}
    SELECT package_id, {oracles.lines("content")} AS rule_lines, {oracles.lines("agents")} AS agents_lines, sha256(content || agents) AS digest FROM made"""


_GLOB = rf"""WITH d AS (SELECT doc_id, {_listed(FRONTS)}[(doc_id % 3)::INTEGER + 1] || replace(replace(text, '. ', {_q(chr(10) + "- ")}), ', ', {_q(chr(10) + "globs: ")}) AS c FROM documents),
  l AS (SELECT doc_id, unnest(string_split(c, {_NL})) AS line, unnest(range(len(string_split(c, {_NL})))) AS i FROM d),
  k AS (SELECT *, CASE WHEN contains(line, 'globs:') THEN 'o' WHEN starts_with({oracles.strip("line")}, '-') THEN 'b' END AS kind FROM l),
  e AS (SELECT doc_id, i, kind = 'b' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = 'o' AS hit FROM k WHERE kind IS NOT NULL)
  SELECT doc_id, sha256(string_agg(CASE WHEN hit THEN '  - "src/**"' ELSE line END, {_NL} ORDER BY i)) AS digest FROM k LEFT JOIN e USING (doc_id, i) GROUP BY 1"""

_KEYS = {**{x: x.lower() for x in TYPED}, **{x: catalog.ALIASES[x.lower()] for x in TYPED if x.lower() in catalog.ALIASES}}
ORACLES: dict[str, str] = {
    "q_folder_rules": _folder_rules(),
    "q_hot_fold": f"""SELECT event_type, length(c)::BIGINT AS chars, sha256(c) AS digest FROM (SELECT event_type, string_agg(user_id || ':' || props, {_NL} ORDER BY event_id) AS c FROM events GROUP BY 1)""",
    "q_substring_join": """WITH n AS (SELECT substr(p_name, (p_partkey % 7 + 1)::INTEGER, (p_partkey % 6 + 1)::INTEGER) AS rule_name FROM part UNION SELECT p_brand || ' ' FROM part)
        SELECT rule_name, min(p_name) AS entry, arg_min(p_type, (p_name, p_type)) AS found FROM n JOIN part ON contains(p_name, rule_name) GROUP BY 1""",
    "q_keyword_table": r"""WITH w AS (SELECT list_sort(list_distinct(flatten(list(string_split_regex(lower(text), '[ \n]'))))) AS ws FROM benchmark),
        h AS (SELECT doc_id, list_filter(ws, lambda k: k <> '' AND contains(lower(text), k)) AS hits FROM documents, w)
        SELECT doc_id, len(hits)::BIGINT AS n_hits, sha256(array_to_string(hits, ' ')) AS digest FROM h""",
    "q_selection_stream": PLAIN["q_selection_fold"],
    "q_answers": f"""WITH {oracles.requests()}, p AS (SELECT request_id, description, length(lang || ' for ' || description[1:5]) AS n FROM asked)
        SELECT request_id, CASE WHEN n % 3 > 0 THEN 'answered ' || n ELSE description END AS content FROM p""",
    "q_glob_rewrite": _GLOB,
    "q_line_budget": f"""WITH c AS (SELECT source, string_split(string_agg(replace(text, '. ', {_NL}) || {_NL}, '' ORDER BY doc_id), {_NL}) AS l FROM documents GROUP BY 1)
        SELECT source, sha256(array_to_string(l[1:150], {_NL}) || CASE WHEN len(l) > 150 THEN {_q(chr(10) + "[... truncated ...]")} ELSE '' END) AS digest FROM c""",
    "q_line_ends": rf"""WITH d AS (SELECT doc_id, text, CASE doc_id % {len(ENDS)} {" ".join(f"WHEN {i} THEN {_chars(x)}" for i, x in enumerate(ENDS))} END AS e FROM documents),
        l AS (SELECT doc_id, replace(text, ', ', e) || CASE WHEN doc_id % 2 = 0 THEN e ELSE '' END AS t FROM d)
        SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]'))
          - CASE WHEN regexp_matches(t, '[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]$') THEN 1 ELSE 0 END END::BIGINT AS lines FROM l""",
    "q_aliases": f"""WITH p AS (SELECT p_partkey, {_listed(TYPED)}[(p_partkey % {len(TYPED)})::INTEGER + 1] AS typed FROM part), k AS (SELECT *, {oracles.chosen(_KEYS, "typed")} AS language FROM p)
        SELECT p_partkey, language, {oracles.chosen(oracles.RULES, "language")} AS rule_name, {oracles.chosen({k: ",".join(v) for k, v in oracles.MORE.items()}, "language", "''")} AS additional,
          {oracles.chosen({k: ",".join(f) for k, (f, _, _) in catalog.LANGUAGES.items()}, "typed", "''")} AS offered, coalesce(list_position({_listed(catalog.PRIMARY)}, language), 0)::INTEGER AS place FROM k""",
    "q_packages": f"""WITH {_listing()} SELECT root, place, folder_path, folder_name, language, array_to_string(fws, ',') AS frameworks, warning FROM packages""",
    "q_monorepo_files": _monorepo(),
}

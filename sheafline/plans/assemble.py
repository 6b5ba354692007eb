"""Documents as ordered sections, folded into artifacts.

Requests, packages and rules stay relations throughout: the documents of any number of
projects are made together. What depends on a language and frameworks alone is made once for
each that are asked for, and a document is put together in its request's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalog
from ..functions import text as t
from ..operators import select
from . import fixed_texts as fixed

ID = "request_id"


def cat(*parts: Column | str) -> Column:
    """Concatenation in which null is ''."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def joined(rows: Column, texts: dict[str, str]) -> list[Column]:
    """Each text of the sorted rows, joined by its separator."""
    return [F.array_join(F.transform(rows, lambda r: r[name]), sep).alias(name) for name, sep in texts.items()]


def fold_few(sections: DataFrame, key: str, sep: str = "") -> DataFrame:
    """As ``fold``, for keys whose sections all come from one row, so that they are as few as it lists."""
    kept = sections.where("text IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return kept.groupBy(key).agg(*joined(ordered, {"text": sep})).withColumnRenamed("text", "content")


def pieces(sections: DataFrame, key: str, texts: dict[str, str]) -> DataFrame:
    """(key, _range, texts): ``sections(key, ord, texts)`` dealt to ranges of (key, ord), joined within each."""
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sections.repartitionByRange(n, key, "ord", *texts).withColumn("_range", F.spark_partition_id())
    ordered = F.array_sort(F.collect_list(F.struct("ord", *texts)))
    return ranged.groupBy(key, "_range").agg(*joined(ordered, texts))


def fold_many(sections: DataFrame, key: str, texts: dict[str, str]) -> DataFrame:
    """(key, texts): each text of ``sections(key, ord, texts)`` joined in order by its own separator.

    ``ord`` may be of any type that has an order. However many sections a key has, a task
    joins those of one range, and ranges are about equal; what then meets are the ranges'
    joined texts, which is the document itself.
    """
    ordered = F.array_sort(F.collect_list(F.struct("_range", *texts)))
    return pieces(sections, key, texts).groupBy(key).agg(*joined(ordered, texts))


def fold(sections: DataFrame, key: str, sep: str = "") -> DataFrame:
    """(key, content): the texts of ``sections(key, ord, text)`` joined in order; null texts are left out.

    Sections of equal ``ord`` come in the order of their texts. A key without a text has no row.
    """
    return fold_many(sections.where("text IS NOT NULL").select(key, "ord", "text"), key, {"text": sep}).withColumnRenamed("text", "content")


def within_lines(sections: DataFrame, key: str, most: int, sep: str = "") -> DataFrame:
    """The sections of which the first ``most`` lines of the joined text take something.

    Line ends before a section are counted over its key, in the partitioning that the fold
    then uses, so what is beyond the budget is never joined.
    """
    ends = F.regexp_count("text", F.lit("\n")) + F.lit(sep.count("\n"))
    before = F.coalesce(F.sum(ends).over(W.partitionBy(key).orderBy("ord", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sections.where("text IS NOT NULL").withColumn("_ends", before).where(F.col("_ends") < most).drop("_ends")


def rule_sections(lists: DataFrame, key: str, wanted: Column, corpus: DataFrame, **made: Column) -> DataFrame:
    """(key, ord, heading, kind, ``made``): ``wanted`` lists struct(ord, rule, heading, kind).

    What is ``made`` of a rule's content is made once a rule, before the rules meet the lists.
    """
    listed = lists.select(key, F.explode(wanted).alias("w")).select(key, "w.*").withColumnRenamed("rule", "rule_name")
    return listed.hint("merge").join(select.filled_rules(listed, corpus, **made), "rule_name")


def with_rules(df: DataFrame, language: str, wanted: Column, corpus: DataFrame, shape, **made: Column) -> DataFrame:
    """``df`` with ``made``, the joined texts of the rules that its language and frameworks want; ``shape(heading, kind)`` gives a text."""
    def texts(lists: DataFrame, key: str) -> DataFrame:
        got = rule_sections(lists, key, wanted, corpus, **made).select(key, "ord", shape(F.col("heading"), F.col("kind")).alias("text"))
        return fold_few(got, key).withColumnRenamed("content", "made")

    return select.per_list(df, [language, "frameworks"], texts)


def body() -> Column:
    return t.extract_body(F.col("content"))


def wanted(ord_from: int, rules: Column, headings: Column, kind: str) -> Column:
    """struct(ord, rule, heading, kind) for rules and headings side by side."""
    return F.transform(F.arrays_zip(rules.alias("r"), headings.alias("h")), lambda x, i: F.struct((i + ord_from).alias("ord"), x["r"].alias("rule"), x["h"].alias("heading"), F.lit(kind).alias("kind")))


def best_practices(heading: Column, kind: Column) -> Column:
    return cat("## ", heading, F.when(kind == "universal", "").otherwise(" Best Practices"), "\n\n", F.col("body"), "\n\n")


def project_context() -> Column:
    return cat(
        "\n## Project Context\n\n**Project Description:**\n", F.col("description"), "\n\n**Technology Stack:**\n- Primary Language: ",
        t.title(F.col("primary_language")), "\n- Frameworks: ", t.joined_or(F.col("frameworks"), "None specified"),
        "\n- Monorepo: ", t.yes_no(F.col("is_monorepo")), "\n\n",
    )


def navigation(last: str) -> Column:
    return F.lit(fixed.NAVIGATION.replace("{last}", last))


def _asked() -> Column:
    return F.coalesce(F.col("frameworks"), F.array().cast("array<string>"))


def _language_rule(ord_at: int) -> Column:
    rule = catalog.rule_name(F.col("primary_language"))
    return wanted(ord_at, select.one(rule), F.array(t.title(F.col("primary_language"))), "language") if ord_at >= 0 else rule


def single_project(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """(request_id, content): the whole document of a single project."""
    has_rule = catalog.rule_name(F.col("primary_language")).isNotNull()
    own = F.when(has_rule, _language_rule(100)).otherwise(F.slice(_language_rule(100), 1, 0))
    theirs = wanted(200, F.transform(_asked(), F.lower), F.transform(_asked(), t.spaced_title), "framework")
    universal = select.universal_without(F.col("frameworks"))
    shared = wanted(100000, universal, F.transform(universal, t.spaced_title), "universal")
    with_text = with_rules(requests, "primary_language", F.concat(own, theirs, shared), corpus, best_practices, body=body())
    whole = cat(
        "# AI Coding Agent Rules\n", project_context(), fixed.GENERAL_PRINCIPLES, F.when(F.col("is_monorepo"), fixed.MONOREPO_STRUCTURE), F.col("made"),
        navigation(fixed.NAVIGATION_SINGLE), fixed.CRITICAL,
    )
    return with_text.select(ID, whole.alias("content"))


def package_list(packages: DataFrame) -> DataFrame:
    """(root, listed, languages): the section on packages, and their languages, per root, in order."""
    framed = F.when(F.size("frameworks") > 0, cat(" with ", F.array_join(F.transform(F.slice("frameworks", 1, 2), t.spaced_title), ", ")))
    entry = cat(
        "- **", F.col("folder_name"), "/**: ", t.title(F.col("language")), framed,
        "\n  - See `", F.col("folder_name"), "/.cursor/rules/` for Cursor rules\n  - See `", F.col("folder_name"), "/AGENTS.md` for cross-tool rules",
    )
    info = cat("- ", F.col("folder_name"), ": ", t.title(F.col("language")), F.when(F.size("frameworks") > 0, cat(" (", F.array_join("frameworks", ", "), ")")), "\n")
    listed = packages.select("root", F.struct("place", "folder_name").alias("ord"), entry.alias("entry"), info.alias("info"))
    texts = fold_many(listed, "root", {"entry": "\n", "info": ""})
    # each language once, where it is first: there are no more than the catalog has and the unknown ones
    seen = packages.groupBy("root", "language").agg(F.min(F.struct("place", "folder_name")).alias("ord"))
    languages = seen.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "language"))), lambda r: r.language).alias("languages"))
    head = "## Package-Specific Rules\n\nEach package has its own rules. When working in a package, refer to:\n\n"
    return texts.join(languages, "root").select(
        "root", cat(head, F.col("entry"), "\n").alias("listed"), cat("\n**Packages:**\n", F.col("info")).alias("info"), "languages",
    )


def monorepo_root(requests: DataFrame, packages: DataFrame, format_mdc: bool, valid: bool = False) -> DataFrame:
    """(request_id, content) of a monorepo's root document.

    The front matter's lines run together, as they always have; ``valid`` puts them on
    lines of their own.
    """
    front = ("\n" if valid else "").join(fixed.MONOREPO_FRONTMATTER) + ("\n" if valid else "")
    with_list = requests.join(package_list(packages), requests.project_root == F.col("root"), "left")
    whole = cat(
        front if format_mdc else "", "# Monorepo AI Coding Rules", project_context(), fixed.GENERAL_PRINCIPLES,
        F.when(F.col("is_monorepo"), fixed.MONOREPO_STRUCTURE), F.col("listed"), navigation(fixed.NAVIGATION_MONOREPO), fixed.CRITICAL,
    )
    return with_list.select(ID, whole.alias("content"))


def folder_glob() -> Column:
    return cat(F.col("folder_path"), "/**/*.", catalog.lookup(catalog.FOLDER_EXTENSIONS, F.col("language"), F.lit("*")))


def front_matter(name: Column, pattern: Column) -> Column:
    return cat("---\ndescription: ", t.title(name), ' package-specific rules\nglobs:\n  - "', pattern, '"\nalwaysApply: false\n---\n\n')


def proper_front_matter(content: Column, name: Column, pattern: Column) -> Column:
    """The content with its glob rewritten, or with front matter put before it if it has none."""
    return F.when(F.startswith(t.strip(content), F.lit("---")), t.rewrite_glob(content, pattern)).otherwise(cat(front_matter(name, pattern), content))


def proper_monorepo_front_matter(content: Column, format_mdc: bool) -> Column:
    if not format_mdc:
        return content
    front = "\n".join(fixed.MONOREPO_FRONTMATTER) + "\n"
    return F.when(~F.startswith(t.strip(content), F.lit("---")), cat(front, content)).otherwise(t.rewrite_lines(content, "alwaysApply:", "alwaysApply: true"))


def _stack(sep_last: str) -> Column:
    named = F.array_join(F.transform(_asked(), t.spaced_title), ", ")
    return cat("## Technology Stack\n- Language: ", t.title(F.col("language")), "\n", F.when(F.size(_asked()) > 0, cat("- Frameworks: ", named, "\n")), sep_last)


def commands() -> Column:
    texts = {k: "".join(c + "\n" for c in v) for k, v in catalog.COMMANDS.items()}
    return cat("## Commands\n", catalog.lookup(texts, F.col("language")), "\n")


def with_folder_rules(packages: DataFrame, corpus: DataFrame) -> DataFrame:
    """``packages`` with ``content``, each one's rule document, at most 150 lines."""
    rule = catalog.rule_name(F.col("language"))
    own = wanted(10, select.one(rule), F.array(t.title(F.col("language"))), "language")
    own = F.when(rule.isNotNull(), own).otherwise(F.slice(own, 1, 0))
    two = F.slice(_asked(), 1, 2)
    theirs = wanted(20, F.transform(two, F.lower), F.transform(two, t.spaced_title), "framework")

    def shape(heading: Column, kind: Column) -> Column:
        return F.when(kind == "language", cat("## ", heading, " Best Practices\n\n", F.col("long"), "\n\n")).otherwise(cat("## ", heading, " Patterns\n\n", F.col("short"), "\n\n"))

    long = t.head_lines(body(), 100, "\n\n[... additional rules apply from general guidelines ...]")
    short = t.head_lines(body(), 80, "\n\n[... truncated for brevity ...]")
    with_text = with_rules(packages, "language", F.concat(own, theirs), corpus, shape, long=long, short=short)
    whole = cat(
        front_matter(F.col("folder_name"), folder_glob()),
        "# ", t.title(F.col("folder_name")), " Package\n\nThis folder contains the **", F.col("folder_name"), "** package.\n\n",
        _stack("\n"), F.col("made"), commands(), fixed.GOTCHAS,
    )
    return with_text.withColumn("content", t.head_lines(whole, 150)).drop("made")


def folder_rules(packages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(package_id, content) of each package's rule document, at most 150 lines."""
    return with_folder_rules(packages, corpus).select("package_id", "content")


def agents_content() -> Column:
    notes = {k: "\n".join(v) + "\n" for k, v in fixed.AGENTS_NOTES.items()}
    listed = {k: "\n".join(v) + "\n" for k, v in fixed.AGENTS_COMMANDS.items()}
    whole = cat(
        "# ", t.title(F.col("folder_name")), " Package\n\nThis folder contains the **", F.col("folder_name"), "** package implementation.\n\n",
        _stack("\n"), "## Commands\n", catalog.lookup(listed, F.col("language")), "\n", "\n".join(fixed.AGENTS_PATTERNS) + "\n",
        catalog.lookup(notes, F.col("language")),
    )
    # sections are joined, not ended, by line ends
    return t.head_lines(F.regexp_replace(whole, "\n\\z", ""), 80)


def agents_document(packages: DataFrame) -> DataFrame:
    """(package_id, content) of each package's cross-tool document, at most 80 lines."""
    return packages.select("package_id", agents_content().alias("content"))


def shared_files(requests: DataFrame, corpus: DataFrame, main: DataFrame | None = None) -> DataFrame:
    """(request_id, path, content) of the shared directory; ``main`` may replace the project's own document."""
    main = single_project(requests, corpus) if main is None else main
    rule = catalog.rule_name(F.col("primary_language"))
    key = catalog.language_key(F.col("primary_language"))
    universal = select.universal_without(F.col("frameworks"))

    def entry(kind: str, rules: Column, headings: Column, names: Column) -> Column:
        z = F.arrays_zip(rules.alias("r"), headings.alias("h"), names.alias("n"))
        return F.transform(z, lambda x: F.struct(F.lit(kind).alias("kind"), x["r"].alias("rule_name"), x["h"].alias("heading"), x["n"].alias("name")))

    own = entry("language", select.one(rule), F.array(t.title(F.col("primary_language"))), F.array(key))
    low = F.transform(_asked(), F.lower)
    everything = F.concat(
        F.when(rule.isNotNull(), own).otherwise(F.slice(own, 1, 0)),
        entry("framework", low, F.transform(_asked(), t.spaced_title), low),
        entry("universal", universal, F.transform(universal, t.spaced_title), universal),
    )
    def files(lists: DataFrame, one: str) -> DataFrame:
        listed = lists.select(one, F.posexplode(everything).alias("ord", "w")).select(one, "ord", "w.*")
        got = select.first_per_group(listed, [one, "kind", "name"], ["ord"], 1).hint("merge").join(select.filled_rules(listed, corpus, body=body()), "rule_name")
        ending = F.when(F.col("kind") == "universal", "").otherwise(" Best Practices")
        path, content = cat(".ai-rules/", F.col("kind"), "-", F.col("name"), ".md"), cat("# ", F.col("heading"), ending, "\n\n", F.col("body"))
        return got.groupBy(one).agg(F.collect_list(F.struct(path.alias("path"), content.alias("content"))).alias("made"))

    rules = select.per_list(requests.select(ID, "primary_language", "frameworks"), ["primary_language", "frameworks"], files).select(ID, F.inline("made"))

    def index_lines(items: Column, line) -> Column:
        return F.array_join(F.transform(items, line), "")

    readme = cat(
        "# Shared AI Rules\n\nThis directory contains shared AI coding rules for this project. These rules are referenced by both Cursor (`.cursorrules`) and Claude Code (`CLAUDE.md`).\n\n"
        "## Files\n\n- `project-rules.md` - Main project-specific rules and guidelines\n",
        F.when(rule.isNotNull(), cat("- `language-", key, ".md` - Language-specific best practices\n")),
        index_lines(_asked(), lambda f: cat("- `framework-", F.lower(f), ".md` - ", t.spaced_title(f), " framework rules\n")),
        index_lines(universal, lambda u: cat("- `universal-", u, ".md` - Universal ", t.spaced_title(u), " rules\n")),
        "\n## Project Information\n\n**Description:** ", F.col("description"), "\n**Language:** ", t.title(F.col("primary_language")),
        "\n**Frameworks:** ", t.joined_or(F.col("frameworks"), "None"), "\n**Monorepo:** ", t.yes_no(F.col("is_monorepo")),
        "\n\n## Usage\n\nThese rules are automatically loaded by:\n- Cursor: Via `.cursorrules` or `.cursor/rules/*.mdc` files\n- Claude Code: Via `CLAUDE.md` files\n\n"
        "You can manually reference specific rule files when needed, or let the tools automatically load the appropriate rules based on context.\n",
    )
    first = main.select(ID, F.lit(".ai-rules/project-rules.md").alias("path"), "content")
    return first.unionByName(rules).unionByName(select.dealt(requests).select(ID, F.lit(".ai-rules/README.md").alias("path"), readme.alias("content")))


def mdc_pointer(description: Column, pattern: Column | None, always: bool) -> Column:
    return cat(
        "---\ndescription: ", description, "\n", F.lit("") if pattern is None else cat('globs:\n  - "', pattern, '"\n'),
        "alwaysApply: ", t.true_false(F.lit(always)), "\n---\n\n# ", description,
        "\n\nThis rule file references shared AI rules in `.ai-rules/` directory.\n\n## Main Rules\n\nSee `.ai-rules/project-rules.md` for comprehensive project rules.\n\n"
        "## Quick Reference\n\n- Project description: ", F.col("description"), "\n- Primary language: ", t.title(F.col("primary_language")),
        "\n- Frameworks: ", t.joined_or(F.col("frameworks"), "None"),
        "\n\n## Rules Location\n\nAll detailed rules are maintained in `.ai-rules/`:\n- `.ai-rules/project-rules.md` - Main project rules\n- `.ai-rules/README.md` - Complete index\n\n"
        "This keeps rules DRY and maintainable across all AI coding tools.\n",
    )


def tool_document(tool: str) -> Column:
    before, after = fixed.TOOL_TEXTS[tool]
    head, tail = before.split("{description}")
    return cat(head, F.col("description"), tail, project_context(), after)


def tool_files(requests: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """(request_id, path, content) for the enabled tools (all if not given), in the tools' order."""
    key = catalog.language_key(F.col("primary_language"))
    own = catalog.rule_name(F.col("primary_language")).isNotNull()
    pattern = cat("**/*.", catalog.lookup(catalog.TOOL_EXTENSIONS, key, F.lit("*")))
    copilot = tool_document("copilot")
    artifacts = {
        "cursor": [
            (F.lit(".cursorrules"), tool_document("cursor")),
            (F.lit(".cursor/rules/main.mdc"), mdc_pointer(F.lit("Project coding rules and guidelines"), None, True)),
            (F.when(own, cat(".cursor/rules/", key, ".mdc")), mdc_pointer(cat(t.title(F.col("primary_language")), " coding standards"), pattern, False)),
        ],
        "claude-code": [(F.lit("CLAUDE.md"), tool_document("claude-code")), (F.lit(".claude/rules/README.md"), F.lit(fixed.CLAUDE_RULES_README))],
        "windsurf": [(F.lit(".windsurfrules"), tool_document("windsurf"))],
        "copilot": [(F.lit(".github/copilot-instructions.md"), copilot), (F.lit(".copilot/instructions.md"), copilot)],
        "warp": [(F.lit(".warp/rules.md"), tool_document("warp"))],
        "janie": [(F.lit(".janie/rules.md"), tool_document("janie"))],
    }
    chosen = [x for tool in catalog.TOOLS if enabled is None or tool in enabled for x in artifacts[tool]]
    if not chosen:
        return requests.select(ID, F.lit("").alias("path"), F.lit("").alias("content")).limit(0)
    rows = F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in chosen])
    return requests.select(ID, F.explode(rows).alias("a")).select(ID, "a.path", "a.content").where("path IS NOT NULL")


def monorepo_files(requests: DataFrame, packages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(request_id, path, content) of a monorepo: the root's documents and three for each package."""
    root = [(".cursor/rules/general.mdc", monorepo_root(requests, packages, True)), ("CLAUDE.md", monorepo_root(requests, packages, False))]
    out = requests.select(ID, F.lit(".cursor/rules/security.mdc").alias("path"), F.lit(fixed.SECURITY).alias("content"))
    for path, made in root:
        out = out.unionByName(made.select(ID, F.lit(path).alias("path"), "content"))
    made = with_folder_rules(with_ids(requests, packages), corpus).withColumn("agents", agents_content())
    at = F.col("folder_path")
    files = [(cat(at, "/.cursor/rules/", F.col("folder_name"), "-patterns.mdc"), "content"), (cat(at, "/AGENTS.md"), "agents"), (cat(at, "/CLAUDE.md"), "agents")]
    rows = F.array(*[F.struct(path.alias("path"), F.col(c).alias("content")) for path, c in files])
    return out.unionByName(made.select(ID, F.inline(rows)))


def with_ids(requests: DataFrame, packages: DataFrame) -> DataFrame:
    own = packages.join(requests.select(ID, F.col("project_root").alias("root")), "root")
    return own.withColumn("package_id", F.concat_ws("/", ID, "folder_path"))


def prompts(df: DataFrame, corpus: DataFrame, corpus_name: str = "rule-corpus", source: str | None = None, key: str = ID) -> DataFrame:
    """(key, prompt) for rows with general_guidelines, project_context, rule_type, format_mdc and names (of rules, in order)."""
    source = source or f"the {corpus_name} repository"

    def references(lists: DataFrame, one: str) -> DataFrame:
        got = select.listed_contents(lists, corpus, one, short=t.head_lines(body(), 100, "\n[... truncated ...]"))
        entry = cat(f"### Reference: {corpus_name}/rules-new/", F.col("rule_name"), ".mdc\n", F.col("short"))
        return fold_few(got.select(one, "ord", entry.alias("text")), one, "\n\n").withColumnRenamed("content", "made")

    head = fixed.PROMPT_RULES.format(corpus=corpus_name, source=source)
    task_head, task_tail = fixed.PROMPT_TASK.split("{rule_type}")
    whole = F.array_join(
        F.array(
            F.lit(fixed.PROMPT_HEADER),
            cat("## General Guidelines for Effective Rules\n\n", F.col("general_guidelines")),
            cat("## Project Context\n\n", F.col("project_context")),
            F.when(F.col("made").isNull(), fixed.PROMPT_NO_RULES).otherwise(cat(head, F.col("made"))),
            cat(task_head, F.col("rule_type"), task_tail),
            F.when(F.col("format_mdc"), fixed.PROMPT_MDC).otherwise(fixed.PROMPT_MARKDOWN),
            F.lit(fixed.PROMPT_FOOTER.replace("{corpus}", corpus_name)),
        ),
        "\n\n",
    )
    return select.per_list(df, ["names"], references).select(key, whole.alias("prompt"))


def or_template(answers: DataFrame, template: DataFrame, key: str = ID) -> DataFrame:
    """(key, content): the answer, or the template's document where there is none."""
    return template.join(answers, key, "left").select(key, t.filled(F.col("answer"), F.col("content")).alias("content"))

"""From a request to files: what the commands run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, schema
from .functions import text as t
from .operators import answers as answered
from .operators import detect, select
from .plans import assemble
from .session import shared_dir
from .sources import corpus as corpora
from .sources import listing, sinks

Ask = Callable[[str], str | None]


def request(spark: SparkSession, description: str, language: str, frameworks: list[str], monorepo: bool = False, output: str = ".cursorrules", root: str = ".") -> DataFrame:
    return spark.createDataFrame([("request", description, monorepo, language, frameworks, output, root)], schema.REQUEST)


def _answers(prompts: DataFrame, ask: Ask, key: str = "request_id") -> DataFrame:
    """Answers by way of a table in the shared folder; a completion that names its model pays for a prompt once and for all."""
    model = getattr(ask, "model", None)
    return answered.answer_once(prompts, ask, f"{shared_dir(prompts.sparkSession)}/answers" + ("" if model else f"-{uuid.uuid4().hex}"), key, model or "")


def _context(df: DataFrame, kind: str, mdc: bool, guidelines: str, context, names) -> DataFrame:
    return df.select(
        "*", F.lit(guidelines).alias("general_guidelines"), context.alias("project_context"), F.lit(kind).alias("rule_type"),
        F.lit(mdc).alias("format_mdc"), names.alias("names"),
    )


def project_document(requests: DataFrame, corpus: DataFrame, guidelines: str = "", ask: Ask | None = None) -> DataFrame:
    """(request_id, content): the completion's answer, or the template's document."""
    template = assemble.single_project(requests, corpus)
    if ask is None:
        return template
    names = select.folder_rule_names(F.col("primary_language"), F.col("frameworks"))
    asked = _context(requests, "single_project", False, guidelines, assemble.project_context(), names)
    answers = _answers(assemble.prompts(asked, corpus), ask)
    return assemble.or_template(answers, template)


def root_documents(requests: DataFrame, packages: DataFrame, corpus: DataFrame, guidelines: str = "", ask: Ask | None = None) -> DataFrame:
    """(request_id, path, content) of a monorepo's root."""
    out = requests.select("request_id", F.lit(".cursor/rules/security.mdc").alias("path"), F.lit(assemble.fixed.SECURITY).alias("content"))
    for path, mdc in ((".cursor/rules/general.mdc", True), ("CLAUDE.md", False)):
        made = assemble.monorepo_root(requests, packages, mdc)
        if ask is not None:
            listed = requests.join(assemble.package_list(packages), requests.project_root == F.col("root"), "left")
            context = assemble.cat(assemble.project_context(), F.coalesce("info", F.lit("\n**Packages:**\n")))
            asked = _context(listed, "monorepo_root", mdc, guidelines, context, select.monorepo_rule_names(F.col("languages")))
            answers = _answers(assemble.prompts(asked, corpus), ask)
            proper = answers.withColumn("answer", assemble.proper_monorepo_front_matter(t.filled(F.col("answer"), F.lit(None)), mdc))
            made = assemble.or_template(proper, made)
        out = out.unionByName(made.select("request_id", F.lit(path).alias("path"), "content"))
    return out


def package_documents(requests: DataFrame, packages: DataFrame, corpus: DataFrame, guidelines: str = "", ask: Ask | None = None) -> DataFrame:
    """(request_id, path, content): one rule document per package, and one text under two names."""
    owned = assemble.with_ids(requests, packages)
    rules, agents = assemble.folder_rules(owned, corpus), assemble.agents_document(owned)
    if ask is not None:
        names = select.folder_rule_names(F.col("language"), F.col("frameworks"))
        glob, listed = assemble.folder_glob(), t.joined_or(F.col("frameworks"), "None")
        head = assemble.cat("\n**Folder:** ", F.col("folder_name"), "\n")
        tail = assemble.cat("**Language:** ", t.title(F.col("language")), "\n**Frameworks:** ", listed, "\n")
        long = assemble.cat(head, "**Path:** ", t.before_glob(glob), "\n", tail, "**Glob Pattern:** ", glob, "\n")
        for mdc, context in ((True, long), (False, assemble.cat(head, tail))):
            asked = _context(owned, "folder", mdc, guidelines, context, names)
            answers = _answers(assemble.prompts(asked, corpus, key="package_id"), ask, "package_id")
            if mdc:
                fixed = owned.join(answers, "package_id").withColumn("answer", assemble.proper_front_matter(t.filled(F.col("answer"), F.lit(None)), F.col("folder_name"), glob))
                fixed = fixed.join(answers.where("answer <> ''").select("package_id"), "package_id", "left_semi")
                rules = assemble.or_template(fixed.select("package_id", "answer"), rules, "package_id")
            else:
                agents = assemble.or_template(answers, agents, "package_id")
    both = agents.withColumn("kind", F.explode(F.array(F.lit("/AGENTS.md"), F.lit("/CLAUDE.md"))))
    own = rules.withColumn("kind", F.lit("patterns"))
    at = owned.select("package_id", "request_id", "folder_path", "folder_name").join(own.unionByName(both), "package_id")
    path = F.when(F.col("kind") == "patterns", assemble.cat(F.col("folder_path"), "/.cursor/rules/", F.col("folder_name"), "-patterns.mdc"))
    return at.select("request_id", path.otherwise(assemble.cat(F.col("folder_path"), F.col("kind"))).alias("path"), "content")


def generate(spark: SparkSession, requests: DataFrame, corpus: DataFrame, root: str, monorepo: bool, output: str, guidelines: str = "", ask: Ask | None = None) -> list[str]:
    """Write a project's document, or a monorepo's; the paths written."""
    if not monorepo:
        made = project_document(requests, corpus, guidelines, ask).select(F.lit(output).alias("path"), "content")
        return sinks.write_artifacts(made, root)
    packages = detect.discover_packages(listing.project_listing(spark, root)).cache()
    made = root_documents(requests, packages, corpus, guidelines, ask).unionByName(package_documents(requests, packages, corpus, guidelines, ask))
    return sinks.write_artifacts(made, root)


def project_init(spark: SparkSession, requests: DataFrame, corpus: DataFrame, root: str, monorepo: bool, tools: list[str], guidelines: str = "", ask: Ask | None = None) -> list[str]:
    """Write the shared directory and the tools' files; a monorepo gets its own documents instead of the tools'."""
    main = project_document(requests, corpus, guidelines, ask)
    done = sinks.write_artifacts(assemble.shared_files(requests, corpus, main), root)
    if monorepo:
        return done + generate(spark, requests, corpus, root, True, "", guidelines, ask)
    return done + sinks.write_artifacts(assemble.tool_files(requests, tools), root)


def base_path(*places: str) -> Path:
    """The first place that has the corpus directory."""
    for place in places:
        if (Path(place) / "rules-new").is_dir():
            return Path(place)
    raise ValueError("no rule corpus found: none of " + ", ".join(places) + " has rules-new/")


def load_corpus(spark: SparkSession, base: Path) -> tuple[DataFrame, str]:
    return corpora.rule_corpus(spark, str(base / "rules-new"), str(base / "rules")), corpora.general_guidelines(str(base / "general_guidelines.md"))

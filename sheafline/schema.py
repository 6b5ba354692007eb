"""Schemas of the relations."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

LANGUAGE = "language string, frameworks array<string>, rule_file string, additional array<string>"
PROVIDER = "key string, name string, env_var string, models array<string>"
TOOL = "pos int, key string, name string, files array<string>"

#: A project to make documents for.
REQUEST = "request_id string, description string, is_monorepo boolean, primary_language string, frameworks array<string>, output_file string, project_root string"
#: A file or folder below a root; folder is its parent's path relative to the root.
LISTING = "root string, parent string, folder string, name string, is_dir boolean, content string"
PACKAGE = "root string, pos int, folder_path string, folder_name string, language string, frameworks array<string>, warning string"
CORPUS = "rule_name string, tier int, content string"
SELECTED = "request_id string, ord int, rule_name string, content string"
ARTIFACT = "request_id string, path string, content string"

USER_CONFIG = StructType(
    [
        StructField("ai_provider", StringType()),
        StructField("ai_model", StringType()),
        StructField("openai_api_key", StringType()),
        StructField("anthropic_api_key", StringType()),
        StructField("enabled_tools", ArrayType(StringType())),
    ]
)
RULE_SEARCH = StructType(
    [
        StructField("language", StringType()),
        StructField("frameworks", ArrayType(StringType())),
        StructField("is_monorepo_root", BooleanType()),
        StructField("all_languages", ArrayType(StringType())),
    ]
)
PROMPT = StructType(
    [
        StructField("general_guidelines", StringType()),
        StructField("project_context", StringType()),
        StructField("relevant_rules", ArrayType(StructType([StructField("name", StringType()), StructField("content", StringType())]))),
        StructField("rule_type", StringType()),
        StructField("format_mdc", BooleanType()),
    ]
)

"""Literal dimensions, as plain values and as small DataFrames.

The values below are fixed: results depend on them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

# --- fixed values -----------------------------------------------------------------------------

_QUALITY = ["codequality", "clean-code"]
_JS = ["react", "vue", "nextjs", "node-express", "tailwind", "astro"]

#: language -> (frameworks, rule file, additional rules)
LANGUAGES: dict[str, tuple[list[str], str | None, list[str]]] = {
    "python": (["fastapi", "django", "flask", "temporal"], "python.mdc", ["database", *_QUALITY]),
    "typescript": (
        [
            "nextjs", "react", "vue", "svelte", "sveltekit", "node-express", "tailwind", "angular", "astro", "nestjs",
            "supabase", "redux", "shadcn", "solidjs", "tauri", "vercel", "cloudflare", "vite", "axios", "zod", "nuxt",
            "expo", "react-native", "jest", "detox", "clasp", "symfony",
        ],
        "typescript.mdc", _QUALITY,
    ),
    "javascript": (_JS, None, _QUALITY),
    "rust": ([], "rust.mdc", _QUALITY),
    "cpp": ([], "cpp.mdc", _QUALITY),
    "java": (["springboot"], None, _QUALITY),
    "go": (["htmx", "temporal"], None, _QUALITY),
    "kotlin": (["ktor", "springboot"], None, _QUALITY),
    "swift": (["uikit", "swiftui"], None, _QUALITY),
    "elixir": (["phoenix"], None, _QUALITY),
    "php": (["laravel", "wordpress"], None, _QUALITY),
    "ruby": (["rails"], None, _QUALITY),
    "scala": ([], None, _QUALITY),
    "r": ([], None, _QUALITY),
    "solidity": (["foundry", "hardhat"], None, _QUALITY),
    "html": (["tailwind"], None, _QUALITY),
    "css": (["tailwind", "material-ui"], None, _QUALITY),
    "js": (_JS, None, _QUALITY),
    "ts": (
        ["nextjs", "react", "vue", "svelte", "sveltekit", "node-express", "tailwind", "angular", "nestjs", "supabase", "redux", "shadcn"],
        "typescript.mdc", _QUALITY,
    ),
}
PRIMARY = [
    "python", "typescript", "javascript", "rust", "cpp", "java", "go", "kotlin", "swift", "elixir", "php", "ruby",
    "scala", "r", "solidity", "html", "css",
]
ALIASES = {"js": "javascript", "ts": "typescript"}
UNIVERSAL = ["codequality", "clean-code", "database", "gitflow"]
MONOREPO_UNIVERSAL = ["codequality", "clean-code", "gitflow"]
PACKAGE_DIRS = ["packages", "apps", "services", "libs", "modules"]
SKIPPED_DIRS = [
    ".git", ".cursor", "node_modules", ".venv", "venv", "env", "__pycache__", "dist", "build", ".next", ".nuxt",
    ".svelte-kit", "target", "bin", "obj",
]
#: Marker files by language, in order of priority; package.json is decided by its content.
MARKERS = {
    "python": ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "poetry.lock"],
    "javascript": ["package.json"],
    "rust": ["Cargo.toml"],
    "go": ["go.mod"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "cpp": ["CMakeLists.txt", "Makefile"],
}
PYTHON_KEYWORDS = ["fastapi", "django", "flask"]
NPM = [
    ("next", "nextjs"), ("react", "react"), ("vue", "vue"), ("svelte", "svelte"), ("sveltekit", "svelte"),
    ("tailwindcss", "tailwind"), ("express", "node-express"),
]
#: The two extension maps differ for TypeScript.
FOLDER_EXTENSIONS = {
    "python": "py", "typescript": "{ts,tsx,js,jsx}", "javascript": "{js,jsx}", "rust": "rs", "go": "go", "java": "java",
    "cpp": "{cpp,hpp,cc,h}",
}
TOOL_EXTENSIONS = FOLDER_EXTENSIONS | {"typescript": "{ts,tsx}"}
COMMANDS = {
    "python": ["- Run tests: `pytest` or `python -m pytest`", "- Install dependencies: `pip install -r requirements.txt`"],
    "typescript": ["- Install: `npm install` or `yarn install`", "- Test: `npm test` or `yarn test`", "- Build: `npm run build` or `yarn build`"],
    "javascript": ["- Install: `npm install`", "- Test: `npm test`"],
}
#: provider -> (name, environment variable, models)
PROVIDERS = {
    "openai": ("OpenAI", "OPENAI_API_KEY", ["gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo"]),
    "anthropic": (
        "Anthropic Claude", "ANTHROPIC_API_KEY",
        ["claude-3-5-sonnet-20241022", "claude-3-5-haiku-20241022", "claude-3-opus-20240229", "claude-3-sonnet-20240229", "claude-3-haiku-20240307"],
    ),
    "none": ("None (Template-based only)", None, ["template"]),
}
#: tool -> (name, files)
TOOLS = {
    "cursor": ("Cursor", [".cursorrules", ".cursor/rules/*.mdc"]),
    "claude-code": ("Claude Code", ["CLAUDE.md", ".claude/rules/"]),
    "windsurf": ("Windsurf", [".windsurfrules"]),
    "copilot": ("GitHub Copilot", [".github/copilot-instructions.md", ".copilot/instructions.md"]),
    "warp": ("Warp", [".warp/rules.md"]),
    "janie": ("Janie", [".janie/rules.md"]),
}
DEFAULT_CONFIG = {"ai_provider": "openai", "ai_model": "gpt-4o-mini", "openai_api_key": None, "anthropic_api_key": None, "enabled_tools": ["cursor", "claude-code"]}

# --- end of fixed values ----------------------------------------------------------------------


def languages(spark: SparkSession) -> DataFrame:
    rows = [(k, f, r, a) for k, (f, r, a) in LANGUAGES.items()]
    return spark.createDataFrame(rows, schema.LANGUAGE)


def language_frameworks(spark: SparkSession) -> DataFrame:
    """(language, pos, framework): the pair view of the language dimension."""
    return languages(spark).select("language", F.posexplode("frameworks").alias("pos", "framework"))


def primary_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRIMARY)), "pos int, language string")


def universal_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(UNIVERSAL)), "pos int, rule_name string")


def package_dirs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PACKAGE_DIRS)), "pos int, dir_name string")


def npm_frameworks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d, f) for i, (d, f) in enumerate(NPM)], "pos int, dep string, framework string")


def markers(spark: SparkSession) -> DataFrame:
    rows = [(name, lang, p) for p, (lang, names) in enumerate(MARKERS.items(), 1) for name in names]
    return spark.createDataFrame(rows, "name string, language string, priority int")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, e, m) for k, (n, e, m) in PROVIDERS.items()], schema.PROVIDER)


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, n, f) for i, (k, (n, f)) in enumerate(TOOLS.items())], schema.TOOL)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a literal map, or the default."""
    found = F.try_element_at(literal_map(pairs), key)
    return found if default is None else F.coalesce(found, default)


def language_key(language: Column) -> Column:
    """Lower-cased, aliases resolved."""
    low = F.lower(language)
    return lookup(ALIASES, low, low)


def rule_name(language: Column) -> Column:
    """Name of the language's rule document; null if it has none."""
    named = {k: r.removesuffix(".mdc") for k, (_, r, _) in LANGUAGES.items() if r}
    return lookup(named, language_key(language))


def available_frameworks(language: Column) -> Column:
    """Frameworks of a language; empty if it is unknown."""
    pairs = [x for k, (f, _, _) in LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, f)) if f else F.array().cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.array().cast("array<string>"))


def additional_rules(language: Column) -> Column:
    pairs = [x for k, (_, _, a) in LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, a)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language_key(language)), F.array().cast("array<string>"))

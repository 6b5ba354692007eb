import json

import pytest
from pyspark.sql import functions as F

from sheafline import cli, engine, schema
from sheafline.operators import completion, detect
from sheafline.plans import assemble, fixed_texts
from sheafline.sources import corpus as corpora
from sheafline.sources import listing, sinks, user_config


@pytest.fixture(scope="module")
def rules(spark):
    long = "\n".join(f"- r{i}" for i in range(120))
    return spark.createDataFrame(
        [
            ("python", 1, f"---\ndescription: x\n---\n\n# Python\n\n{long}\n"), ("fastapi", 1, f"---\n---\n# F\n{long}"), ("clean-code", 1, "# C\nclean"),
            ("codequality", 1, "quality"), ("database", 1, "db"),
        ],
        schema.CORPUS,
    )


def request(spark, **kw):
    base = {"description": "A shop", "language": "python", "frameworks": ["fastapi"], "monorepo": False, "root": "r"}
    return engine.request(spark, **(base | kw))


CONTEXT = "\n## Project Context\n\n**Project Description:**\nA shop\n\n**Technology Stack:**\n- Primary Language: Python\n- Frameworks: {f}\n- Monorepo: {m}\n\n"


def test_single_project(spark, rules):
    got = assemble.single_project(request(spark, frameworks=["fastapi", "Database"]), rules).first().content
    long = "\n".join(f"- r{i}" for i in range(120))
    want = (
        "# AI Coding Agent Rules\n" + CONTEXT.format(f="fastapi, Database", m="No") + fixed_texts.GENERAL_PRINCIPLES
        + f"## Python Best Practices\n\n{long}\n\n## Fastapi Best Practices\n\n{long}\n\n## Database Best Practices\n\ndb\n\n"
        + "## Codequality\n\nquality\n\n## Clean Code\n\nclean\n\n"
        + fixed_texts.NAVIGATION.replace("{last}", fixed_texts.NAVIGATION_SINGLE) + fixed_texts.CRITICAL
    )
    assert got == want


def packages(spark):
    rows = [("r", 2, "apps/web-ui", "web-ui", "typescript", ["nextjs", "node-express", "x"], None), ("r", 3, "services/api", "api", "python", ["fastapi"], None), ("r", 3, "services/core", "core", "rust", [], None)]
    return spark.createDataFrame(rows, "root string, place int, folder_path string, folder_name string, language string, frameworks array<string>, warning string")


def test_monorepo_root(spark):
    got = assemble.monorepo_root(request(spark, monorepo=True, frameworks=[]), packages(spark), True).first().content
    assert got.startswith('---description: Monorepo-wide coding rules and guidelinesglobs:  - "**/*"alwaysApply: true---# Monorepo AI Coding Rules' + CONTEXT.format(f="None specified", m="Yes"))
    assert fixed_texts.MONOREPO_STRUCTURE in got
    assert (
        "## Package-Specific Rules\n\nEach package has its own rules. When working in a package, refer to:\n\n- **web-ui/**: Typescript with Nextjs, Node Express\n"
        "  - See `web-ui/.cursor/rules/` for Cursor rules\n  - See `web-ui/AGENTS.md` for cross-tool rules\n- **api/**: Python with Fastapi\n"
    ) in got
    assert "- **core/**: Rust\n" in got
    assert assemble.monorepo_root(request(spark), packages(spark).limit(0), False).first().content.count("Package-Specific") == 0
    assert assemble.monorepo_root(request(spark), packages(spark), True, valid=True).first().content.startswith("---\ndescription: Monorepo-wide")


def test_folder_documents(spark, rules):
    owned = assemble.with_ids(request(spark), packages(spark))
    got = {r.package_id: r.content for r in assemble.folder_rules(owned, rules).collect()}
    api = got["request/services/api"]
    assert api.startswith('---\ndescription: Api package-specific rules\nglobs:\n  - "services/api/**/*.py"\nalwaysApply: false\n---\n\n# Api Package\n\nThis folder contains the **api** package.\n\n## Technology Stack\n- Language: Python\n- Frameworks: Fastapi\n\n## Python Best Practices\n\n- r0\n')
    assert "- r99\n\n[... additional rules apply from general guidelines ...]\n\n## Fastapi Patterns\n\n" in api and len(api.split("\n")) == 150
    assert got["request/services/core"].endswith("## Commands\n\n" + fixed_texts.GOTCHAS)
    agents = {r.package_id: r.content for r in assemble.agents_document(owned).collect()}
    assert agents["request/services/api"] == (
        "# Api Package\n\nThis folder contains the **api** package implementation.\n\n## Technology Stack\n- Language: Python\n- Frameworks: Fastapi\n\n## Commands\n"
        "- Install: `pip install -r requirements.txt`\n- Test: `pytest`\n- Lint: `flake8 .` or `black --check .`\n\n## Patterns\n"
        "- Follow the established architecture patterns in this folder\n- Use existing utilities and helpers before creating new ones\n"
        "- Maintain consistency with the overall monorepo structure\n\n### Python Notes\n- Follow PEP 8 style guide\n- Use type hints for all functions\n"
    )
    assert agents["request/services/core"].endswith("## Commands\n\n## Patterns\n" + "\n".join(fixed_texts.AGENTS_PATTERNS[1:]))


def test_tool_and_shared_files(spark, rules):
    r = request(spark, language="ts", frameworks=[])
    got = {x.path: x.content for x in assemble.tool_files(r, ["copilot", "cursor"]).collect()}
    assert list(got) == [".cursorrules", ".cursor/rules/main.mdc", ".cursor/rules/typescript.mdc", ".github/copilot-instructions.md", ".copilot/instructions.md"]
    assert got[".cursor/rules/typescript.mdc"].startswith('---\ndescription: Ts coding standards\nglobs:\n  - "**/*.{ts,tsx}"\nalwaysApply: false\n---\n\n# Ts coding standards\n')
    assert got[".cursor/rules/main.mdc"].startswith("---\ndescription: Project coding rules and guidelines\nalwaysApply: true\n---\n\n# Project coding")
    assert assemble.tool_files(r).count() == 10 and assemble.tool_files(request(spark, language="go"), ["cursor"]).count() == 2 and assemble.tool_files(r, []).count() == 0
    shared = {x.path: x.content for x in assemble.shared_files(request(spark, frameworks=["fastapi", "absent"]), rules).collect()}
    assert set(shared) == {f".ai-rules/{n}.md" for n in ("project-rules", "README", "language-python", "framework-fastapi", "universal-codequality", "universal-clean-code", "universal-database")}
    assert "- `framework-absent.md` - Absent framework rules\n" in shared[".ai-rules/README.md"]
    assert shared[".ai-rules/universal-clean-code.md"] == "# Clean Code\n\nclean"


def test_prompts_and_completion(spark, rules):
    asked = []

    def context(ask):
        return engine.project_document(request(spark), rules, "guide", ask).first().content

    assert context(lambda p: f"asked {p.count('### Reference: rule-corpus/rules-new/')} {p.count('[... truncated ...]')}") == "asked 5 2"
    assert context(lambda p: "").startswith("# AI Coding Agent Rules")
    assert context(None).startswith("# AI Coding Agent Rules") and not asked
    assert completion.completion("none", "template") is None
    assert completion.openai_completion("m", None)("p") is None or True
    df = spark.createDataFrame([("1", "g", "c", "folder", True, ["absent"])], "request_id string, general_guidelines string, project_context string, rule_type string, format_mdc boolean, names array<string>")
    prompt = assemble.prompts(df, rules).first().prompt
    assert fixed_texts.PROMPT_NO_RULES in prompt and fixed_texts.PROMPT_MDC in prompt and "rules document for this folder that" in prompt


def test_front_matter_of_answers(spark):
    df = spark.createDataFrame([("body",), ('---\nglobs:\n  - "x"\n---\nb',), ("---\nalwaysApply: false\n---\nsee alwaysApply: x",)], "s string")
    got = [r.v for r in df.select(assemble.proper_front_matter(F.col("s"), F.lit("web"), F.lit("G")).alias("v")).collect()]
    assert got[0] == '---\ndescription: Web package-specific rules\nglobs:\n  - "G"\nalwaysApply: false\n---\n\nbody' and '  - "G"' in got[1]
    root = [r.v for r in df.select(assemble.proper_monorepo_front_matter(F.col("s"), True).alias("v")).collect()]
    assert root[0].startswith("---\ndescription: Monorepo-wide") and root[0].endswith("---\n\nbody") and root[2] == "---\nalwaysApply: true\n---\nalwaysApply: true"


def test_sources_and_commands(spark, tmp_path, monkeypatch, capsys):
    base, root = tmp_path / "corpus", tmp_path / "project"
    (base / "rules-new").mkdir(parents=True)
    (base / "rules-new" / "python.mdc").write_bytes(b"---\r\nd: x\r\n---\r\n# P\r\nuse it\r\n")
    (base / "rules" / "some-flask-rules").mkdir(parents=True)
    (base / "rules" / "some-flask-rules" / ".cursorrules").write_text("flask it")
    (root / "apps" / "api").mkdir(parents=True)
    (root / "apps" / "api" / "requirements.txt").write_text("fastapi")
    got = {r.rule_name: r.content for r in corpora.rule_corpus(spark, str(base / "rules-new"), str(base / "rules")).collect()}
    assert got == {"python": "---\nd: x\n---\n# P\nuse it\n", "some-flask-rules": "flask it"}
    assert corpora.general_guidelines(str(base / "none.md")) == ""
    found = detect.discover_packages(listing.project_listing(spark, str(root))).first()
    assert (found.folder_path, found.language, found.frameworks) == ("apps/api", "python", ["fastapi"])
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "cfg"))
    common = ["--corpus", str(base), "--project-root", str(root), "--no-ai", "--description", "d", "--language", "python", "--frameworks", "flask"]
    monkeypatch.setattr(cli, "session", lambda *a, **k: spark)
    assert cli.main(["generate", *common]) == 0
    assert "## Flask Best Practices\n\nflask it" in (root / ".cursorrules").read_text()
    assert cli.main(["project-init", *common]) == 0
    assert (root / ".ai-rules" / "README.md").exists() and (root / "CLAUDE.md").exists() and not (root / ".windsurfrules").exists()
    assert cli.main(["generate", *common, "--monorepo"]) == 0
    assert (root / "apps/api/AGENTS.md").read_text() == (root / "apps/api/CLAUDE.md").read_text()
    assert (root / "apps/api/.cursor/rules/api-patterns.mdc").exists() and (root / ".cursor/rules/security.mdc").read_text() == fixed_texts.SECURITY
    assert cli.main([]) == 0 and cli.main(["config", "set", "ai_provider", "nobody"]) == 1 and cli.main(["config", "set", "enabled_tools", "warp, cursor"]) == 0
    assert user_config.load(user_config.config_path())["enabled_tools"] == ["warp", "cursor"]
    assert cli.main(["config", "show"]) == 0 and "Warp, Cursor" in capsys.readouterr().out
    assert cli.main(["config", "reset"]) == 0 and user_config.load(user_config.config_path()) is None
    with pytest.raises(ValueError):
        sinks.write_artifacts(spark.createDataFrame([("../x", "y")], "path string, content string"), str(root))


def test_config_round_trip(spark):
    rows = [('{"ai_model": "m", "extra": 1}',), ('{"enabled_tools": null}',), ("{bad",), ("{}",)]
    got = [r.config for r in user_config.parse_configs(spark.createDataFrame(rows, "json string")).collect()]
    assert got[0].ai_model == "m" and got[0].ai_provider == "openai" and got[1].enabled_tools == ["cursor", "claude-code"] and got[2] is None
    row = user_config.as_row(spark, {"ai_provider": "none", "ai_model": "t", "enabled_tools": ["warp"]})
    made = user_config.format_configs(row.select(F.struct("*").alias("config"))).first().json
    assert json.loads(made) == {"ai_provider": "none", "ai_model": "t", "openai_api_key": None, "anthropic_api_key": None, "enabled_tools": ["warp"]}

"""SQL for the documents of many projects, on the supplied tables; what it must give is written out again here."""

from __future__ import annotations

from . import catalog
from .plans import fixed_texts as fixed

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TITLE = (
    "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({0}, i - 1, 1), '[A-Za-z]') "
    "THEN lower(substr({0}, i, 1)) ELSE upper(substr({0}, i, 1)) END), '')"
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def listed(xs) -> str:
    return "CAST([" + ", ".join(map(quoted, xs)) + "] AS VARCHAR[])"


def chosen(pairs: dict, c: str, other: str = "NULL", show=quoted) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {quoted(k)} THEN {show(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


def spaced(c: str) -> str:
    return TITLE.format(f"replace({c}, '-', ' ')")


def lines(c: str) -> str:
    return f"(len(string_split({c}, chr(10))) - CASE WHEN {c} LIKE '%' || chr(10) THEN 1 ELSE 0 END)::INTEGER"


RULES = {k: r.removesuffix(".mdc") for k, (_, r, _) in catalog.LANGUAGES.items() if r}
MORE = {k: a for k, (_, _, a) in catalog.LANGUAGES.items()}
CONTEXT = f"""(chr(10) || '## Project Context' || chr(10) || chr(10) || '**Project Description:**' || chr(10) || description || chr(10) || chr(10) || '**Technology Stack:**'
  || chr(10) || '- Primary Language: ' || {TITLE.format("lang")} || chr(10) || '- Frameworks: ' || CASE WHEN len(fws) > 0 THEN array_to_string(fws, ', ') ELSE 'None specified' END
  || chr(10) || '- Monorepo: ' || CASE WHEN mono THEN 'Yes' ELSE 'No' END || chr(10) || chr(10))"""


def requests() -> str:
    return f"""req AS (SELECT p_partkey::VARCHAR AS request_id, p_name AS description, p_partkey % 2 = 0 AS mono,
      {listed(catalog.PRIMARY)}[(p_partkey % {len(catalog.PRIMARY)})::INTEGER + 1] AS lang, ['fastapi', 'react', 'Database'][1:(p_partkey % 4)::INTEGER] AS fws FROM part),
    asked AS (SELECT *, {chosen(RULES, "lang")} AS rule, list_filter({listed(catalog.UNIVERSAL)}, lambda u: NOT list_contains(list_transform(fws, lambda f: lower(f)), u)) AS universal FROM req)"""


def bodies(corpus: list[tuple[str, int, str]]) -> str:
    """rule_name, body for every name that a request can ask for, if the corpus has it."""
    names = sorted({*RULES.values(), *catalog.UNIVERSAL, "fastapi", "react", *(x for a in MORE.values() for x in a)})
    rows = ", ".join(f"({quoted(n)}, {tier}, {quoted(c)})" for n, tier, c in corpus)
    rest = strip("array_to_string(string_split(c, chr(10))[2:], chr(10))")
    return f"""corpus(entry, tier, content) AS (VALUES {rows}),
    parted AS (SELECT *, string_split(content, chr(10)) AS l FROM corpus),
    plain AS (SELECT entry, tier, {strip(f"CASE WHEN {strip('l[1]')} = '---' THEN array_to_string(l[coalesce(list_position(list_transform(l[2:], lambda x: {strip('x')}), '---'), 0) + 2:], chr(10)) ELSE content END")} AS c FROM parted),
    cut AS (SELECT entry, tier, CASE WHEN c[1] = '#' THEN {rest} ELSE c END AS body FROM plain),
    found AS (SELECT rule_name, coalesce(min(body) FILTER (tier = 1 AND entry = rule_name), arg_min(body, entry) FILTER (tier = 2 AND contains(entry, rule_name))) AS body
      FROM (SELECT unnest({listed(names)}) AS rule_name), cut GROUP BY 1 HAVING body IS NOT NULL)"""


def rule_selection(corpus) -> str:
    return f"""WITH {requests()}, {bodies(corpus)},
    names AS (SELECT request_id, list_concat(CASE WHEN rule IS NULL THEN CAST([] AS VARCHAR[]) ELSE [rule] END, {chosen(MORE, "lang", "CAST([] AS VARCHAR[])", listed)}, list_transform(fws[1:3], lambda f: lower(f))) AS names FROM asked),
    each AS (SELECT request_id, unnest(range(len(names)))::INTEGER AS ord, unnest(names) AS rule_name FROM names)
    SELECT request_id, ord, rule_name, length(body)::BIGINT AS chars FROM each JOIN found USING (rule_name)"""


def wanted_rules() -> str:
    """request_id, kind, ord, rule_name, heading, name of every rule that a request asks for."""
    return f"""wanted AS (
      SELECT request_id, 'language' AS kind, 0 AS ord, rule AS rule_name, {TITLE.format("lang")} AS heading, lang AS name FROM asked WHERE rule IS NOT NULL
      UNION ALL SELECT request_id, 'framework', 200 + i, lower(f), {spaced("f")}, lower(f) FROM (SELECT request_id, unnest(fws) AS f, unnest(range(len(fws))) AS i FROM asked)
      UNION ALL SELECT request_id, 'universal', 900 + i, u, {spaced("u")}, u FROM (SELECT request_id, unnest(universal) AS u, unnest(range(len(universal))) AS i FROM asked)),
    ruled AS (SELECT *, heading || CASE WHEN kind = 'universal' THEN '' ELSE ' Best Practices' END || chr(10) || chr(10) || body AS told FROM wanted JOIN found USING (rule_name))"""


def projects(corpus) -> str:
    navigation = fixed.NAVIGATION.replace("{last}", fixed.NAVIGATION_SINGLE)
    return f"""{requests()}, {bodies(corpus)}, {wanted_rules()},
    joined AS (SELECT request_id, string_agg('## ' || told || chr(10) || chr(10), '' ORDER BY ord) AS rules FROM ruled GROUP BY 1),
    project AS (SELECT request_id, '# AI Coding Agent Rules' || chr(10) || {CONTEXT} || {quoted(fixed.GENERAL_PRINCIPLES)} || CASE WHEN mono THEN {quoted(fixed.MONOREPO_STRUCTURE)} ELSE '' END
      || coalesce(rules, '') || {quoted(navigation)} || {quoted(fixed.CRITICAL)} AS content FROM asked LEFT JOIN joined USING (request_id))"""


def single_project(corpus) -> str:
    return f"WITH {projects(corpus)} SELECT request_id, sha256(content) AS digest, {lines('content')} AS lines FROM project"


def shared_files(corpus) -> str:
    intro = (
        "# Shared AI Rules\n\nThis directory contains shared AI coding rules for this project. These rules are referenced by both Cursor (`.cursorrules`) and Claude Code (`CLAUDE.md`).\n\n"
        "## Files\n\n- `project-rules.md` - Main project-specific rules and guidelines\n"
    )
    usage = (
        "\n\n## Usage\n\nThese rules are automatically loaded by:\n- Cursor: Via `.cursorrules` or `.cursor/rules/*.mdc` files\n- Claude Code: Via `CLAUDE.md` files\n\n"
        "You can manually reference specific rule files when needed, or let the tools automatically load the appropriate rules based on context.\n"
    )
    return f"""WITH {projects(corpus)},
    readme AS (SELECT request_id, {quoted(intro)} || CASE WHEN rule IS NULL THEN '' ELSE '- `language-' || lang || '.md` - Language-specific best practices' || chr(10) END
      || array_to_string(list_transform(fws, lambda f: '- `framework-' || lower(f) || '.md` - ' || {spaced("f")} || ' framework rules' || chr(10)), '')
      || array_to_string(list_transform(universal, lambda u: '- `universal-' || u || '.md` - Universal ' || {spaced("u")} || ' rules' || chr(10)), '')
      || chr(10) || '## Project Information' || chr(10) || chr(10) || '**Description:** ' || description || chr(10) || '**Language:** ' || {TITLE.format("lang")}
      || chr(10) || '**Frameworks:** ' || CASE WHEN len(fws) > 0 THEN array_to_string(fws, ', ') ELSE 'None' END || chr(10) || '**Monorepo:** ' || CASE WHEN mono THEN 'Yes' ELSE 'No' END
      || {quoted(usage)} AS content FROM asked)
    SELECT request_id, '.ai-rules/project-rules.md' AS path, sha256(content) AS digest FROM project
    UNION ALL SELECT request_id, '.ai-rules/README.md', sha256(content) FROM readme
    UNION ALL SELECT request_id, '.ai-rules/' || kind || '-' || name || '.md', sha256('# ' || told) FROM ruled"""


def pointer(description: str, pattern: str | None, always: str) -> str:
    globs = "" if pattern is None else f" || 'globs:' || chr(10) || '  - \"' || {pattern} || '\"' || chr(10)"
    after = (
        "\n\nThis rule file references shared AI rules in `.ai-rules/` directory.\n\n## Main Rules\n\nSee `.ai-rules/project-rules.md` for comprehensive project rules.\n\n"
        "## Quick Reference\n\n- Project description: "
    )
    last = (
        "\n\n## Rules Location\n\nAll detailed rules are maintained in `.ai-rules/`:\n- `.ai-rules/project-rules.md` - Main project rules\n- `.ai-rules/README.md` - Complete index\n\n"
        "This keeps rules DRY and maintainable across all AI coding tools.\n"
    )
    return f"""'---' || chr(10) || 'description: ' || {description} || chr(10){globs} || 'alwaysApply: {always}' || chr(10) || '---' || chr(10) || chr(10) || '# ' || {description} || {quoted(after)} || description
      || chr(10) || '- Primary language: ' || {TITLE.format("lang")} || chr(10) || '- Frameworks: ' || CASE WHEN len(fws) > 0 THEN array_to_string(fws, ', ') ELSE 'None' END || {quoted(last)}"""


def tool_files() -> str:
    def document(tool: str) -> str:
        before, after = fixed.TOOL_TEXTS[tool]
        head, tail = before.split("{description}")
        return f"{quoted(head)} || description || {quoted(tail)} || {CONTEXT} || {quoted(after)}"

    pattern = f"'**/*.' || {chosen(catalog.TOOL_EXTENSIONS, 'lang', quoted('*'))}"
    files = {
        "'.cursorrules'": document("cursor"), "'.cursor/rules/main.mdc'": pointer(quoted("Project coding rules and guidelines"), None, "true"),
        "CASE WHEN rule IS NOT NULL THEN '.cursor/rules/' || lang || '.mdc' END": pointer(f"({TITLE.format('lang')} || ' coding standards')", f"({pattern})", "false"),
        "'CLAUDE.md'": document("claude-code"), "'.claude/rules/README.md'": quoted(fixed.CLAUDE_RULES_README), "'.windsurfrules'": document("windsurf"),
        "'.github/copilot-instructions.md'": document("copilot"), "'.copilot/instructions.md'": document("copilot"), "'.warp/rules.md'": document("warp"), "'.janie/rules.md'": document("janie"),
    }
    rows = " UNION ALL ".join(f"SELECT request_id, {path} AS path, sha256({content}) AS digest FROM asked" for path, content in files.items())
    return f"WITH {requests()} SELECT * FROM ({rows}) WHERE path IS NOT NULL"


def selection_fold(answers: list[str], first: str) -> str:
    return rf"""WITH RECURSIVE said AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, word) AS k, word
      FROM (SELECT conv_id, turn, {listed(answers)}[((length(text) + turn) % {len(answers)})::INTEGER + 1] AS word FROM conversations)),
    s AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS k, {listed([first])} AS selected, list_filter({listed(catalog.PRIMARY)}, lambda x: x <> {quoted(first)}) AS remaining, false AS done FROM conversations
      UNION ALL
      SELECT conv_id, k, CASE WHEN done THEN selected WHEN word = 'clear' THEN CAST([] AS VARCHAR[]) WHEN word <> 'done' AND named IS NOT NULL THEN list_append(selected, named) ELSE selected END,
        CASE WHEN done THEN remaining WHEN word = 'clear' THEN {listed(catalog.PRIMARY)} WHEN word <> 'done' AND named IS NOT NULL THEN list_filter(remaining, lambda x: x <> named) ELSE remaining END,
        done OR (word = 'done' AND len(selected) > 0)
      FROM (SELECT s.conv_id, said.k, word, selected, remaining, done, CASE WHEN regexp_full_match(word, '\d+') AND word::INTEGER BETWEEN 1 AND least(len(remaining), 25) THEN remaining[word::INTEGER]
          WHEN word = '' THEN remaining[1] WHEN len(list_filter(remaining, lambda x: contains(x, lower(word)))) = 1 THEN list_filter(remaining, lambda x: contains(x, lower(word)))[1] END AS named
        FROM s JOIN said ON said.conv_id = s.conv_id AND said.k = s.k + 1))
    SELECT conv_id, array_to_string(selected, ',') AS selected, done FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1"""


def front_matter(front: str, pattern: str) -> str:
    entry = f'  - "{pattern}"'
    return f"""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN {quoted(front.replace("  - old/**", entry))}
      ELSE '---' || chr(10) || 'description: ' || {TITLE.format("source")} || {quoted(" package-specific rules" + chr(10) + "globs:" + chr(10) + entry + chr(10) + "alwaysApply: false" + chr(10) + "---" + chr(10) * 2)} END || text) AS digest FROM documents"""


def prompt(corpus, corpus_name: str = "rule-corpus") -> str:
    gap = quoted("\n\n")
    head = fixed.PROMPT_RULES.format(corpus=corpus_name, source=f"the {corpus_name} repository")
    task, after = fixed.PROMPT_TASK.split("{rule_type}")
    return f"""WITH {requests()}, {bodies(corpus)},
    names AS (SELECT request_id, list_concat(CASE WHEN rule IS NULL THEN CAST([] AS VARCHAR[]) ELSE [rule] END, {chosen(MORE, "lang", "CAST([] AS VARCHAR[])", listed)}, list_transform(fws[1:3], lambda f: lower(f))) AS names FROM asked),
    each AS (SELECT request_id, unnest(range(len(names))) AS ord, unnest(names) AS rule_name FROM names),
    short AS (SELECT rule_name, string_split(body, chr(10)) AS l, body FROM found),
    rules AS (SELECT request_id, string_agg('### Reference: {corpus_name}/rules-new/' || rule_name || '.mdc' || chr(10)
      || CASE WHEN len(l) > 100 THEN array_to_string(l[1:100], chr(10)) || chr(10) || '[... truncated ...]' ELSE body END, {gap} ORDER BY ord) AS rules FROM each JOIN short USING (rule_name) GROUP BY 1)
    SELECT request_id, sha256({quoted(fixed.PROMPT_HEADER)} || {gap} || '## General Guidelines for Effective Rules' || {gap} || 'Be brief.' || {gap} || '## Project Context' || {gap} || description || {gap}
      || CASE WHEN rules IS NULL THEN {quoted(fixed.PROMPT_NO_RULES)} ELSE {quoted(head)} || rules END || {gap} || {quoted(task + "project" + after)} || {gap}
      || CASE WHEN mono THEN {quoted(fixed.PROMPT_MDC)} ELSE {quoted(fixed.PROMPT_MARKDOWN)} END || {gap} || {quoted(fixed.PROMPT_FOOTER.replace("{corpus}", corpus_name))}) AS digest
    FROM asked LEFT JOIN rules USING (request_id)"""


def monorepo_root(roots: int) -> str:
    navigation = fixed.NAVIGATION.replace("{last}", fixed.NAVIGATION_MONOREPO)
    listing = "## Package-Specific Rules\n\nEach package has its own rules. When working in a package, refer to:\n\n"
    return f"""WITH {requests()},
    entries AS (SELECT request_id::INTEGER % {roots} AS root, request_id::INTEGER % 3 AS place, 'pkg-' || request_id AS name,
      '- **pkg-' || request_id || '/**: ' || {TITLE.format("lang")} || CASE WHEN len(fws) > 0 THEN ' with ' || array_to_string(list_transform(fws[1:2], lambda f: {spaced("f")}), ', ') ELSE '' END
      || chr(10) || '  - See `pkg-' || request_id || '/.cursor/rules/` for Cursor rules' || chr(10) || '  - See `pkg-' || request_id || '/AGENTS.md` for cross-tool rules' AS entry FROM asked),
    listed AS (SELECT root, {quoted(listing)} || string_agg(entry, chr(10) ORDER BY place, name) || chr(10) AS listed FROM entries GROUP BY 1)
    SELECT request_id, sha256({quoted("".join(fixed.MONOREPO_FRONTMATTER))} || '# Monorepo AI Coding Rules' || {CONTEXT} || {quoted(fixed.GENERAL_PRINCIPLES)}
      || CASE WHEN mono THEN {quoted(fixed.MONOREPO_STRUCTURE)} ELSE '' END || listed || {quoted(navigation)} || {quoted(fixed.CRITICAL)}) AS digest
    FROM asked JOIN listed ON root = request_id::INTEGER % {roots} WHERE request_id::INTEGER < {roots}"""


SCALARS = """SELECT p_partkey, p_brand AS folder, p_name || '|' || p_brand || '|x' AS listed,
  coalesce(nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4), ', '), ''), 'None') AS long_words,
  CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS large, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS flag, p_partkey % 3 <> 1 AS parsed,
  CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'outside' END AS below,
  array_to_string(list_transform(range(1, least(p_size, 3) + 1), lambda i: 'Opt ' || i), ', ') || CASE WHEN p_size > 3 THEN ' ... (+' || (p_size - 3) || ' more)' ELSE '' END AS summary
FROM part"""

"""Commands: init, config show|edit|set|reset, project-init, generate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__, catalog, engine
from .operators import completion
from .session import session
from .sources import user_config

YES = ("y", "yes", "true", "1")


def masked(key: str | None) -> str:
    return "Not set (using environment variable)" if not key else "****" if len(key) < 8 else "*" * 10 + key[-4:]


def show(config: dict) -> str:
    tools = ", ".join(catalog.TOOLS[x][0] if x in catalog.TOOLS else x for x in config["enabled_tools"]) or "None"
    provider = catalog.PROVIDERS.get(config["ai_provider"], (config["ai_provider"],))[0]
    return "\n".join([
        f"AI Provider: {provider}", f"AI Model: {config['ai_model']}", f"Enabled AI Coding Tools: {tools}",
        f"OpenAI: {masked(config['openai_api_key'])}", f"Anthropic: {masked(config['anthropic_api_key'])}",
    ])


def current() -> dict:
    return user_config.load(user_config.config_path()) or {k: v for k, v in catalog.DEFAULT_CONFIG.items()}


def cmd_config(args: argparse.Namespace) -> int:
    path = user_config.config_path()
    if args.action == "show":
        print(show(current()))
    elif args.action == "reset":
        print("Configuration reset to defaults." if user_config.reset(path) else "No configuration file found. Already using defaults.")
    elif args.action == "set":
        wrong = user_config.valid(session("local[2]"), args.key, args.value)
        if wrong:
            print(f"Error: {wrong}", file=sys.stderr)
            return 1
        value = [x.strip() for x in args.value.split(",")] if args.key == "enabled_tools" else args.value
        user_config.save(current() | {args.key: value}, path)
    else:
        edit(path)
    return 0


def edit(path: Path) -> None:
    config = current()
    for key in catalog.DEFAULT_CONFIG:
        old = config[key]
        typed = input(f"{key} [{','.join(old) if isinstance(old, list) else masked(old) if key.endswith('_key') else old}]: ").strip()
        if typed:
            config[key] = [x.strip() for x in typed.split(",")] if isinstance(old, list) else typed
    user_config.save(config, path)


def cmd_init(args: argparse.Namespace) -> int:
    path = user_config.config_path()
    if path.exists() and input("A configuration exists. Replace it? (y/n): ").strip().lower() not in ("y", "yes"):
        return 0
    edit(path)
    return 0


def ask_request(args: argparse.Namespace) -> tuple[str, str, list[str], bool]:
    """From the flags if they give a description and a language, else by questions."""
    if not getattr(args, "interactive", False) and args.description and args.language:
        return args.description, args.language, [x.strip() for x in (args.frameworks or "").split(",") if x.strip()], args.monorepo
    description = args.description or input("Project description: ").strip()
    monorepo = args.monorepo or input("Monorepo? (y/n): ").strip().lower() in YES
    print(", ".join(catalog.PRIMARY))
    language = args.language or input("Primary language: ").strip()
    print(", ".join(catalog.LANGUAGES.get(language, ([],))[0]))
    frameworks = [x.strip() for x in input("Frameworks, separated by commas: ").split(",") if x.strip()]
    if not description or not language:
        raise ValueError("a description and a language are needed")
    return description, language, frameworks, monorepo


def completion_of(config: dict, no_ai: bool):
    return None if no_ai else completion.completion(config["ai_provider"], config["ai_model"], config["openai_api_key"], config["anthropic_api_key"])


def cmd_generate(args: argparse.Namespace) -> int:
    config, root = current(), str(Path(args.project_root or ".").resolve())
    base = engine.base_path(*([args.corpus] if args.corpus else []), str(Path(__file__).parent), str(Path(__file__).parent.parent), ".")
    description, language, frameworks, monorepo = ask_request(args)
    spark = session(args.master)
    corpus, guidelines = engine.load_corpus(spark, base)
    requests = engine.request(spark, description, language, frameworks, monorepo, args.output, root)
    ask = completion_of(config, args.no_ai)
    if args.command == "project-init":
        if (Path(root) / ".ai-rules").exists() and input("Rules exist already. Replace them? (y/n): ").strip().lower() not in ("y", "yes"):
            return 0
        done = engine.project_init(spark, requests, corpus, root, monorepo, config["enabled_tools"], guidelines, ask)
    else:
        done = engine.generate(spark, requests, corpus, root, monorepo, args.output, guidelines, ask)
    print("\n".join(done))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sheafline", description="Documents of rules for projects")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command")
    sub.add_parser("init").set_defaults(func=cmd_init)
    config = sub.add_parser("config")
    config.set_defaults(func=cmd_config)
    actions = config.add_subparsers(dest="action", required=True)
    for name in ("show", "edit", "reset"):
        actions.add_parser(name)
    setter = actions.add_parser("set")
    setter.add_argument("key")
    setter.add_argument("value")
    for name in ("project-init", "generate"):
        p = sub.add_parser(name)
        p.set_defaults(func=cmd_generate)
        p.add_argument("--project-root")
        p.add_argument("--no-ai", action="store_true")
        p.add_argument("--corpus", help="folder that has rules-new/ and, if there is one, rules/")
        p.add_argument("--master", default="local[*]")
        p.add_argument("--description")
        p.add_argument("--monorepo", action="store_true")
        p.add_argument("--language")
        p.add_argument("--frameworks")
        p.add_argument("--output", default=".cursorrules")
        p.add_argument("--interactive", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    try:
        return args.func(args)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

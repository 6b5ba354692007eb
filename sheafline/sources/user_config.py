"""The user's preferences: a JSON file read against a schema, with defaults for what it lacks."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog, schema

APP = "sheafline"
FILE = "config.json"


def config_path(env: dict[str, str] | None = None, platform: str = sys.platform, home: Path | None = None) -> Path:
    """Where the preferences are; the folder is made if it is missing."""
    env, home = os.environ if env is None else env, home or Path.home()
    if platform == "win32":
        base = Path(env.get("APPDATA") or home / "AppData" / "Roaming")
    elif platform == "darwin":
        base = home / "Library" / "Application Support"
    else:
        base = Path(env.get("XDG_CONFIG_HOME") or home / ".config")
    folder = base / APP
    folder.mkdir(parents=True, exist_ok=True)
    return folder / FILE


def parse_configs(df: DataFrame, column: str = "json") -> DataFrame:
    """Preferences from JSON texts: unknown keys dropped, missing ones and null tools defaulted, malformed texts null."""
    c = F.from_json(column, schema.USER_CONFIG)
    given = F.from_json(column, "map<string,string>")
    tools = F.array(*map(F.lit, catalog.DEFAULT_CONFIG["enabled_tools"]))

    def value(name: str):
        default = catalog.DEFAULT_CONFIG[name]
        return F.when(F.map_contains_key(given, name), c[name]).otherwise(F.lit(default)).alias(name)

    made = F.struct(
        value("ai_provider"), value("ai_model"), c["openai_api_key"].alias("openai_api_key"), c["anthropic_api_key"].alias("anthropic_api_key"),
        F.coalesce(c["enabled_tools"], tools).alias("enabled_tools"),
    )
    return df.withColumn("config", F.when(F.try_parse_json(column).isNotNull(), made))


def format_configs(df: DataFrame, column: str = "config") -> DataFrame:
    return df.withColumn("json", F.to_json(column, {"pretty": "true", "ignoreNullFields": "false"}))


def load(path: Path) -> dict | None:
    """The preferences; None if there are none, or with a warning if they can't be read."""
    if not path.exists():
        return None
    try:
        given = json.loads(path.read_text(encoding="utf-8"))
        made = {k: given.get(k, d) for k, d in catalog.DEFAULT_CONFIG.items()}
    except (OSError, ValueError, AttributeError) as e:
        print(f"Warning: Could not load config from {path}: {e}", file=sys.stderr)
        return None
    if made["enabled_tools"] is None:
        made["enabled_tools"] = list(catalog.DEFAULT_CONFIG["enabled_tools"])
    return made


def save(config: dict, path: Path) -> None:
    path.write_text(json.dumps({k: config.get(k) for k in catalog.DEFAULT_CONFIG}, indent=2), encoding="utf-8")


def reset(path: Path) -> bool:
    """Whether there was a file to delete."""
    if path.exists():
        path.unlink()
        return True
    return False


def as_row(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([tuple(config.get(f.name) for f in schema.USER_CONFIG)], schema.USER_CONFIG)


def valid(spark: SparkSession, key: str, value: str) -> str | None:
    """What is wrong with a setting, or None."""
    from ..operators.options import unknown

    if key not in catalog.DEFAULT_CONFIG:
        return f"unknown key {key}"
    known = {"ai_provider": catalog.providers, "enabled_tools": catalog.tools}.get(key)
    if known is not None:
        asked = [(x.strip(),) for x in value.split(",")] if key == "enabled_tools" else [(value,)]
        bad = unknown(spark.createDataFrame(asked, "key string"), known(spark), "key").collect()
        if bad:
            return f"unknown {key}: {', '.join(r.key for r in bad)}"
    return None

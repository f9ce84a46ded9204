"""Notes, rule files, baselines and index artifacts."""

from __future__ import annotations

import json
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "at string, id string, kind string, sym string, file string, aliases array<string>, rel array<string>, tags array<string>, note string"
VERSION = 3


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes from JSON lines; malformed lines are dropped."""
    return spark.read.schema(NOTE).option("mode", "DROPMALFORMED").json(path)


def append_note(spark: SparkSession, path: str, note: dict, today: date | None = None) -> None:
    row = {"at": (today or date.today()).isoformat(), "tags": [], **note}
    names = [f.split()[0] for f in NOTE.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], NOTE).write.mode("append").json(path)


class _Line:
    """A line of a rule file: how deep it is indented, whether a dash begins an entry, its key and its value's pieces."""

    def __init__(self, raw: str):
        self.dash, self.key, self.pieces = False, None, []
        text = raw.expandtabs(2)
        body = text.lstrip(" ")
        self.indent = self.dash_at = len(text) - len(body)
        if body.startswith("- "):
            self.dash, inner = True, body[2:].lstrip(" ")
            self.indent += len(body) - len(inner)
            body = inner
        at, word, quoted = 0, "", ""
        while at < len(body):
            c = body[at]
            if quoted:
                if c == quoted:
                    self.pieces.append((word, True))
                    word, quoted = "", ""
                else:
                    word += c
            elif c in "'\"" and not word.strip():
                word, quoted = "", c
            elif c == "#" and (at == 0 or body[at - 1] == " "):
                break
            elif c == ":" and self.key is None and not self.pieces and body[at + 1 : at + 2] in ("", " "):
                self.key, word = word.strip(), ""
            elif c in "[],":
                self._end(word)
                self.pieces.append((c, False))
                word = ""
            else:
                word += c
            at += 1
        self._end(word)

    def _end(self, word: str) -> None:
        if word.strip():
            self.pieces.append((word.strip(), False))

    @property
    def empty(self) -> bool:
        return self.key is None and not self.pieces

    def value(self):
        """A list for what stands in brackets, else a truth value, a number or a text; None for nothing."""
        if self.pieces and self.pieces[0] == ("[", False):
            return [w for w, q in self.pieces if q or w not in "[],"]
        if not self.pieces:
            return None
        word, quoted = " ".join(w for w, _ in self.pieces), any(q for _, q in self.pieces)
        if quoted:
            return word
        return {"true": True, "false": False}.get(word, int(word) if word.lstrip("-").isdigit() else word)


def _tree(text: str) -> dict:
    """Nested mappings and lists, by indentation."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(0, root)]
    waiting: list[tuple[int, dict, str]] = []  # keys whose value may be on the lines below
    for line in map(_Line, text.splitlines()):
        if line.empty:
            continue
        if line.dash:
            while waiting and waiting[-1][0] > line.dash_at:
                waiting.pop()
            entries = waiting[-1][1].setdefault(waiting[-1][2], []) if waiting else None
            if not isinstance(entries, list):
                continue
            entries.append({} if line.key else line.value())
            if not line.key:
                continue
            open_ = [x for x in open_ if x[0] <= line.dash_at] + [(line.indent, entries[-1])]
        else:
            while waiting and waiting[-1][0] >= line.indent:
                waiting.pop()
            if line.key and waiting and waiting[-1][2] not in waiting[-1][1]:
                _, into, key = waiting.pop()
                into[key] = {}
                open_.append((line.indent, into[key]))
            while len(open_) > 1 and open_[-1][0] > line.indent:
                open_.pop()
        if line.key and line.pieces:
            open_[-1][1][line.key] = line.value()
        elif line.key:
            waiting.append((line.indent, open_[-1][1], line.key))
    return root


def parse_policy(text: str) -> dict:
    """Rules of modules: ``modules`` (a list of mappings) and ``global``, with scalars, lists in brackets or by dashes, and comments."""
    raw = _tree(text)
    listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]

    def path(x) -> str:
        return "/".join(part for part in str(x).replace("\\", "/").split("/") if part not in ("", "."))

    modules = []
    for m in listed(raw.get("modules")):
        if isinstance(m, dict):
            own = {"id": str(m.get("id") or ""), "managed": m.get("managed") is True, "requires": [str(r) for r in listed(m.get("requires"))]}
            own |= {k: [path(p) for p in listed(m.get(k)) if path(p)] for k in ("roots", "publicEntrypoints")}
            modules.append(m | own)
    rules = raw.get("global") if isinstance(raw.get("global"), dict) else {}
    version = raw.get("version")
    return {"version": version if isinstance(version, int) else 1, "modules": modules, "global": rules | {k: rules.get(k) is not False for k in ("forbidCycles", "forbidDeepImports")}}


def policy_errors(policy: dict) -> list[str]:
    """What keeps a rule file from being used."""
    found = [] if policy["modules"] else ["no modules are declared"]
    seen: set[str] = set()
    for m in policy["modules"]:
        if not m["id"]:
            found.append("a module has no id")
        elif m["id"] in seen:
            found.append(f"module {m['id']} is declared twice")
        if not m["roots"]:
            found.append(f"module {m['id']} has no roots")
        seen.add(m["id"])
    return found


def policy_tables(spark: SparkSession, policy: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots (root, module, position), requires (module, required), entry points (module, entry)."""
    mods = policy["modules"]
    roots = [(r, m["id"], i) for i, m in enumerate(mods) for r in m["roots"]]
    return (
        spark.createDataFrame(roots, "root string, module string, position int"),
        spark.createDataFrame([(m["id"], r) for m in mods for r in m["requires"]], "module string, required string"),
        spark.createDataFrame([(m["id"], e) for m in mods for e in m["publicEntrypoints"]], "module string, entry string"),
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Violations accounted for; a missing file is an empty baseline, lines that are none are left out."""
    schema = "rule string, file string, detail string, module string, fp string"
    try:
        return spark.read.schema(schema).json(path).where(F.col("fp").isNotNull())
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_baseline(violations: DataFrame, path: str) -> None:
    violations.select("rule", "file", "detail", "module", "fp").coalesce(1).write.mode("overwrite").json(path)


def write_artifact(tables: dict[str, DataFrame], path: str, commit: str | None = None) -> None:
    """The relations of an index as Parquet tables, with the version in ``meta``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, json.dumps(sorted(tables)), commit)], "version int, tables string, commit string").write.mode("overwrite").parquet(f"{path}/meta")


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """The same relations as JSON lines, for readers without Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_artifact(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], str | None]:
    """The tables of an index and the commit that it was made at."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise ValueError(f"the index at {path} has version {meta['version']}, not {VERSION}: build it again")
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(meta["tables"])}, meta["commit"]

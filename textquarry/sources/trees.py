"""Trees of files on the driver: targets of a scan, incidents, evidence artefacts, packages, and rules about paths."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import evidence, triage
from textquarry.sources.files import MAX_FILES, tree_glob

# Branches with the paths they may touch, names that systems leave behind, roots of evidence, first times of a package.
BRANCH_SCOPES = {
    "ci/": ["scripts/ci/**", ".github/**", "*.md"],
    "docs/": ["docs/**", "*.md"],
    "fix/ci-": ["scripts/ci/**", ".github/**", "*.md", "products/**/docs/**/*.md", "products/**/tests/**/*.md"],
}
SYSTEM_NAMES = [".DS_Store", "._.DS_Store", "Thumbs.db", "ehthumbs.db", "Desktop.ini"]
EVIDENCE_ROOTS = ["decisions", "prs", "validation"]
ZIP_TIME = (1980, 1, 1, 0, 0, 0)
# End of fixed values.


class Found(NamedTuple):
    """A path of a listing, where it leads, and what is there: file, directory or other."""

    path: Path
    real: Path
    kind: str


def look(path: Path) -> Found:
    real = path.resolve()
    return Found(path, real, "file" if real.is_file() else "directory" if real.is_dir() else "other")


def reasons(roots: list[Path], extensions: set[str], follow_links: bool) -> list[tuple[str, Callable[[Found], bool]]]:
    """Why a path is left out; the first that holds is the reason. A link that leads out of the roots is traversal, whether links are followed or not; a followed one that leads nowhere is no file."""
    return [
        ("path_traversal", lambda f: not any(f.real.is_relative_to(r) for r in roots)),
        ("symlink_skipped", lambda f: f.path.is_symlink() and not follow_links),
        ("extension_filtered", lambda f: f.kind == "file" and bool(extensions) and f.real.suffix.lower() not in extensions),
        ("special_file", lambda f: f.kind == "other"),
    ]


def collect_targets(inputs: list[str], extensions: list[str] | None = None, follow_links: bool = False, max_files: int = MAX_FILES) -> tuple[list[str], list[tuple[str, str]]]:
    """Files below the inputs by path, each once, at most max_files; and what was left out, with reasons. A folder is listed once, so links that go round in circles end."""
    if max_files < 1:
        raise ValueError("max_files is below 1")
    given = [(Path(x), Path(x).resolve()) for x in inputs]
    skipped = [(str(path), "not_found") for path, real in given if not real.exists()]
    roots = [real.parent if real.is_file() else real for _, real in given if real.exists()]
    rules = reasons(roots, {f".{e.lower().removeprefix('.')}" for e in extensions or []}, follow_links)
    found, listed = set(), set()
    todo = [path for path, real in reversed(given) if real.exists()]  # what is next is last
    while todo and len(found) < max_files:
        f = look(todo.pop())
        reason = next((name for name, holds in rules if holds(f)), None)
        if reason:
            skipped.append((str(f.path), reason))
        elif f.kind == "file":
            found.add(str(f.real))
        elif f.real not in listed:
            listed.add(f.real)
            try:
                todo += [f.real / name for name in sorted(os.listdir(f.real), reverse=True)]
            except PermissionError:
                skipped.append((str(f.path), "permission_denied"))
            except OSError as e:
                skipped.append((str(f.path), f"read_error:{e}"))
    if len(found) >= max_files:
        skipped.append(("<truncated>", f"max_files_exceeded:{len(found)}"))
    return sorted(found), skipped


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """One incident per JSON file."""
    return spark.read.schema(triage.SCHEMA).json(path, multiLine=True)


def evidence_files(spark: SparkSession, root: str) -> DataFrame:
    """canonical_path, content, sha256_path, sidecar of the canonical JSON files below the evidence roots; sidecar is null where it is missing."""
    found = [str(p) for r in EVIDENCE_ROOTS for p in sorted((Path(root) / r).glob("*.canonical.json"))]
    rows = [(os.path.relpath(p, root), Path(p).read_text(encoding="utf-8"), os.path.relpath(p, root) + ".sha256", Path(p + ".sha256").read_text(encoding="utf-8") if Path(p + ".sha256").is_file() else None) for p in found]
    return spark.createDataFrame([("/" + a, b, "/" + c, d) for a, b, c, d in rows], "canonical_path string, content string, sha256_path string, sidecar string")


def evidence_items(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose checksum line is right, with their time and source; and the others with an error."""
    g = lambda p: F.get_json_object("content", p)
    rows = found.withColumns({"sha256": F.sha2("content", 256), "side": evidence.parse_sidecar(F.col("sidecar"))})
    error = F.when(F.col("sidecar").isNull(), "no checksum file").when(F.col("side").isNull(), "no checksum line").when(F.col("side.sha256") != F.col("sha256"), "checksum differs")
    rows = rows.withColumn("error", error)
    kind = evidence.kind_of(F.col("canonical_path"))
    stamp = F.coalesce(g("$.timestamp_utc"), g("$.mergedAt"), g("$.captured_at_utc"))
    source = F.when(kind == "decision", g("$.adr_path")).otherwise(F.coalesce(g("$.source"), g("$.url")))
    good = rows.filter("error IS NULL").select("canonical_path", "sha256", "sha256_path", stamp.alias("timestamp_utc"), source.alias("source_ref"))
    return good, rows.filter("error IS NOT NULL").select("canonical_path", "error")


def index_artifacts(index: dict) -> dict[str, str]:
    """The files of an index: readable, canonical, and the canonical one's checksum line."""
    compact = json.dumps(index, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"INDEX.json": json.dumps(index, sort_keys=True, indent=2, ensure_ascii=False) + "\n", "INDEX.canonical.json": compact, "INDEX.canonical.json.sha256": f"{hashlib.sha256(compact.encode()).hexdigest()}  INDEX.canonical.json\n"}


def write_index(index: dict, folder: str) -> None:
    for name, text in index_artifacts(index).items():
        (Path(folder) / name).write_text(text, encoding="utf-8")


def index_drift(index: dict, folder: str) -> list[str]:
    """Files of an index that are missing or differ from what would be written."""
    return [n for n, t in index_artifacts(index).items() if not (Path(folder) / n).is_file() or (Path(folder) / n).read_text(encoding="utf-8") != t]


def package(root: str, target: str, patterns: list[str]) -> list[dict]:
    """A zip of the files that match, by path, with fixed times; the same input gives the same bytes. Returns path, sha256, bytes of each."""
    import re

    wanted = [re.compile(tree_glob(p)) for p in patterns]
    paths = sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())
    manifest = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in (p for p in paths if any(w.match(p) for w in wanted)):
            content = (Path(root) / name).read_bytes()
            info = zipfile.ZipInfo(name, ZIP_TIME)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, content)
            manifest.append({"path": name, "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)})
    return manifest


def out_of_scope(changed: DataFrame, branch: str, path: str = "path", scopes: dict[str, list[str]] = BRANCH_SCOPES) -> DataFrame:
    """Changed paths that the first scope whose prefix the branch has doesn't allow; none for other branches."""
    allowed = next((globs for prefix, globs in scopes.items() if branch.startswith(prefix)), None)
    if allowed is None:
        return changed.limit(0)
    test = F.lit(False)
    for g in allowed:
        test = test | F.col(path).rlike(tree_glob(g))
    return changed.filter(~test)


def system_artifacts(paths: DataFrame, path: str = "path") -> DataFrame:
    base = F.regexp_extract(path, "[^/]*$", 0)
    return paths.filter(base.isin(SYSTEM_NAMES) & ~F.col(path).rlike(r"(^|/)\.git/")).orderBy(path)


def manifest_errors(text: Column, required: list[str], array: str | None = None, element_keys: tuple[str, ...] = ()) -> Column:
    """Lints of a JSON manifest: required keys that are missing or null, and elements of an array that lack a key."""
    checks = [(~evidence.json_valid(text), "no JSON")] + [(F.get_json_object(text, f"$.{k}").isNull(), f"missing key: {k}") for k in required]
    if array:
        elements = F.from_json(F.get_json_object(text, f"$.{array}"), "array<map<string,string>>")
        checks += [(_lacks(elements, k), f"{array}: an element lacks {k}") for k in element_keys]
    return evidence.errors(checks)


def _lacks(elements: Column, key: str) -> Column:
    return F.coalesce(F.exists(elements, lambda e: ~F.map_contains_key(e, key)), F.lit(False))


def relative_source_errors(source: Column) -> Column:
    return evidence.errors([(source.isNull() | (source == ""), "no source"), (~F.startswith(source, F.lit("./")), "source doesn't begin with ./"), (source.rlike(r"(^|/)\.\.(/|$)"), "source leaves the tree")])


def decision_errors(docs: DataFrame, sections: list[str], receipts: DataFrame, column: str = "text") -> DataFrame:
    """docs and errors: sections that are missing, no or several receipt links, a receipt that isn't there. receipts: path."""
    link = r"[\w./-]+\.canonical\.json"
    rows = docs.withColumn("_links", F.array_distinct(F.regexp_extract_all(column, F.lit(link), F.lit(0)))).withColumn("_path", F.get("_links", F.lit(0)))
    known = receipts.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(known, "_path", "left")
    more = evidence.errors([(F.size("_links") == 0, "no receipt"), (F.size("_links") > 1, "several receipts"), ((F.size("_links") == 1) & F.col("_there").isNull(), "receipt isn't there")])
    return rows.withColumn("errors", F.concat(evidence.section_errors(F.col(column), sections), more)).drop("_links", "_path", "_there")


def relative_to(path: Column, root: str) -> Column:
    """A path below root without it, other paths as they are."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def name_warnings(name: Column) -> Column:
    """A name should be in kebab case."""
    return evidence.errors([(~F.coalesce(name.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "name isn't in kebab case")])


def source_folder_errors(root: str, sources: list[str]) -> list[tuple[str, str]]:
    """Sources of a manifest on the driver that are no folder below root, links followed."""
    top, out = Path(root).resolve(), []
    for source in sources:
        real = (top / source).resolve()
        reason = "leaves the tree" if not real.is_relative_to(top) else "not found" if not real.exists() else "no folder" if not real.is_dir() else None
        if reason:
            out.append((source, reason))
    return out


def merge_receipt(data: dict) -> dict:
    """What a request's receipt keeps, by name; only of one that was merged."""
    if data.get("state") != "MERGED":
        raise ValueError(f"not merged (state: {data.get('state', '')})")
    return {k: data[k] for k in ("baseRefName", "headRefName", "mergeCommit", "mergedAt", "number", "state", "title", "url") if k in data}


def log_table_errors(docs: DataFrame, header: str, columns: int, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """id, errors of Markdown log tables: no header line, no rule of dashes, and rows with another number of columns."""
    lines = F.filter(F.split(F.col(column), "\n", -1), lambda x: F.startswith(F.trim(x), F.lit("|")))
    wrong = F.filter(lines, lambda x: F.size(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1)) != columns)
    return docs.select(F.col(id_col).alias("id"), evidence.errors([(~F.array_contains(lines, header), "no header"), (~F.exists(lines, lambda x: F.contains(x, F.lit("---"))), "no rule"), (F.size(wrong) > 0, "a row has another number of columns")]).alias("errors"))

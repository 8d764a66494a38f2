"""Files: listing, bounded reads, search, path policy, policies and packs on disk, and canonical output.

Whole trees are read by Spark (binaryFile); single files and their policies are driver work.
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import path_hash, universal_lines
from textquarry.operators import policy
from textquarry.operators.lexicon import entries_sha256, fields_signature, normalized_sha256, pretty_json, sha256

# Names of files that are never shown, limits, and the keys of packs and locks.
BLOCKED = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "id_ecdsa", "id_ecdsa.*",
    "authorized_keys", "known_hosts", "credentials", "credentials.*", "secrets", "secrets.*", "*_SECRET", "*_KEY", "*_TOKEN", "*_PASSWORD",
    "*.db", "*.sqlite", "*.sqlite3", "*.kdb", "*.kdbx", ".git/config", ".npmrc", ".pypirc", ".docker/config.json", ".aws/credentials", ".aws/config", "*.kubeconfig", "kubeconfig",
]
MAX_FILES, MAX_SCAN_BYTES, MAX_FILE_BYTES, MAX_RESPONSE, MAX_RESULTS, MAX_SEARCHED = 5000, 1_000_000, 1_048_576, 524_288, 100, 10_000
PACK_KEYS = ["created_at_utc", "description", "entries_path", "entry_format", "fields", "language", "license", "name", "pack_id", "schema_version", "source_attribution"]
LOCK_KEYS = ["entries_path", "entries_sha256", "entry_count", "field_count", "fields_signature", "generated_at_utc", "lock_schema_version", "normalized_entries_sha256", "pack_id", "pack_json_sha256"]
VERSION = "1.0.0"
# End of fixed values.


def detect_type(path: Column, explicit: str | None = None) -> Column:
    return F.lit(explicit) if explicit in ("text", "pdf") else F.when(F.endswith(F.lower(path), F.lit(".pdf")), "pdf").otherwise("text")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, extensions: list[str] | None = None, max_bytes: int = MAX_SCAN_BYTES, max_files: int | None = MAX_FILES) -> DataFrame:
    """file, text, truncated, length: the first max_bytes of each file of a tree, by path; max_files is the budget of a scan (None: all)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if extensions:
        wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
        rows = rows.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(wanted))
    if max_files is not None:
        rows = rows.orderBy("path").limit(max_files)
    return rows.select(F.col("path").alias("file"), decoded(F.expr(f"substring(content, 1, {int(max_bytes)})")).alias("text"), (F.col("length") > max_bytes).alias("truncated"), "length")


def ranged(content: Column, offset: int = 0, limit: int | None = None, max_bytes: int = MAX_FILE_BYTES, max_chars: int = MAX_RESPONSE) -> Column:
    """struct<content,bytes_read,truncated> of a range of bytes; an offset at or past the end reads nothing."""
    part = F.substring(content, offset + 1, min(limit if limit is not None else max_bytes, max_bytes))
    text = decoded(part)
    return F.struct(F.substring(text, 1, max_chars).alias("content"), F.octet_length(part).alias("bytes_read"), (F.char_length(text) > max_chars).alias("truncated"))


def blocked(path: Column, patterns: list[str] = BLOCKED) -> Column:
    """The first pattern that a path's last part matches, or that is a part of the path if it has a slash; null if none."""
    base, whole = F.regexp_extract(path, r"[^/\\]*$", 0), F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        test = base.rlike("(?s)" + glob_regex(p))
        out = F.when(test | F.contains(whole, F.lit(p)) if "/" in p else test, p).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A name's glob (*, ?) as a Java pattern for the whole name."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w])", r"\\\1", c) for c in pattern) + "$"


def tree_glob(pattern: str) -> str:
    """A path's glob as a Java pattern: ** crosses folders, * and ? don't; a pattern without a slash is of the root alone."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([^\w/])", r"\\\1", c)), i + 1
    return f"^{out}$"


def path_decision(path: Column, roots: list[str], patterns: list[str] = BLOCKED) -> Column:
    """struct<allowed,reason>: the first of traversal_detected, blocked_pattern, outside_allowed_roots that holds. Paths are absolute; links are not followed."""
    hit = blocked(path, patterns)
    under = F.lit(False)
    for r in roots:
        under = under | (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/"))
    reason = F.when(path.rlike(r"(^|/)\.\.(/|$)"), "traversal_detected").when(hit.isNotNull(), "blocked_pattern").when(~under, "outside_allowed_roots")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def allowed_path(path: str, roots: list[str], patterns: list[str] = BLOCKED) -> tuple[bool, str | None]:
    """The same for one file on the driver, with links followed."""
    if ".." in path.split(os.sep):
        return False, "traversal_detected"
    real = os.path.realpath(os.path.expanduser(path))
    if any(fnmatch.fnmatch(os.path.basename(real), p) or "/" in p and p in real for p in patterns):
        return False, "blocked_pattern"
    if not any(real == (r := os.path.realpath(x)) or real.startswith(r.rstrip("/") + "/") for x in roots):
        return False, "outside_allowed_roots"
    return True, None


def list_dir(folder: str, roots: list[str], limit: int = MAX_RESULTS) -> tuple[list[dict], bool]:
    """Entries by name with kind and size; denied ones carry the reason instead. Whether more than limit were there."""
    ok, reason = allowed_path(folder, roots)
    if not ok:
        raise PermissionError(reason)
    out = []
    for name in sorted(os.listdir(folder)):
        full = os.path.join(folder, name)
        ok, reason = allowed_path(full, roots)
        out.append({"name": name, "type": "directory" if os.path.isdir(full) else "file", "size": os.path.getsize(full) if ok and os.path.isfile(full) else None, "accessible": ok, "denial_reason": reason})
    return out[:limit], len(out) > limit


def search(texts: DataFrame, pattern: str, limit: int = MAX_RESULTS, budget: int | None = MAX_SEARCHED, file: str = "file", column: str = "text") -> DataFrame:
    """file, line, begin, end, content of the first limit matches by file, line and place, over the first budget files (None: all)."""
    from textquarry.functions.spans import spans

    if budget is not None:
        texts = texts.orderBy(file).limit(budget)
    rows = texts.filter(F.col(column).rlike(pattern)).select(F.col(file).alias("file"), F.posexplode(universal_lines(F.col(column))).alias("k", "content")).filter(F.col("content").rlike(pattern))
    rows = rows.select("file", (F.col("k") + 1).alias("line"), F.explode(spans(F.col("content"), pattern)).alias("s"), F.rtrim("content").alias("content"))
    return rows.select("file", "line", F.col("s.col_start").alias("begin"), F.col("s.col_end").alias("end"), "content").orderBy("file", "line", "begin").limit(limit)


def audit_rows(entries: DataFrame) -> DataFrame:
    """entries: timestamp, operation, path, success, denial_reason, metadata. Paths are shown as a hash's beginning beside their last part alone."""
    return entries.select("timestamp", "operation", F.regexp_extract("path", "[^/]*$", 0).alias("path"), path_hash(F.col("path")).alias("path_hash"), "success", "denial_reason", "metadata")


def append_audit(entries: DataFrame, folder: str) -> None:
    audit_rows(entries).write.mode("append").json(folder)


def audit_entry(operation: str, path: str | None, success: bool, now: str, denial_reason: str | None = None, **metadata) -> dict:
    """An entry for audit_rows(): what was done, where, and numbers about it as texts; never content."""
    return {"timestamp": now, "operation": operation, "path": path, "success": success, "denial_reason": denial_reason, "metadata": {k: str(v) for k, v in metadata.items() if v is not None}}


def read_audit(path: str, size: int, truncated: bool, now: str) -> dict:
    return audit_entry("read_file", path, True, now, bytes=size, truncated=truncated)


def list_audit(path: str, entries: int, truncated: bool, now: str) -> dict:
    return audit_entry("list_dir", path, True, now, entries=entries, truncated=truncated)


def search_audit(path: str, results: int, searched: int, now: str) -> dict:
    return audit_entry("search_text", path, True, now, results=results, files_searched=searched)


def denied_audit(operation: str, path: str, reason: str, now: str) -> dict:
    return audit_entry(operation, path, False, now, reason)


AUDIT_SCHEMA = "timestamp string, operation string, path string, success boolean, denial_reason string, metadata map<string,string>"


def read_range(path: str, roots: list[str], offset: int = 0, limit: int | None = None, max_bytes: int = MAX_FILE_BYTES) -> dict:
    """A range of bytes of one allowed file on the driver: content, bytes_read, offset, and whether more follows."""
    ok, reason = allowed_path(path, roots)
    if not ok:
        raise PermissionError(reason)
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("offset and limit can't be below 0")
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    wanted = max_bytes if limit is None else min(limit, max_bytes)
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(wanted)
        more = bool(f.read(1))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return {"content": text, "bytes_read": len(data), "offset": offset, "truncated": more}


#: Fixed value: names of policy packs.
PACK_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def policy_packs(folder: str | None = None) -> list[str]:
    """Names of the built-in packs and of the pack files of a folder, in order."""
    own = [p.stem for p in Path(folder).glob("*.json")] if folder else []
    return sorted({*policy.PACKS, *(n for n in own if re.fullmatch(PACK_NAME, n))})


def policy_pack(name: str, folder: str | None = None) -> list[policy.Policy]:
    """The policies of a pack: a file of the folder before a built-in one."""
    if not re.fullmatch(PACK_NAME, name):
        raise ValueError(f"{name!r} is no name of a pack")
    if folder and (Path(folder) / f"{name}.json").is_file():
        return load_policies(str(Path(folder) / f"{name}.json"))
    if name not in policy.PACKS:
        raise ValueError(f"no pack {name}; there are {', '.join(policy_packs(folder))}")
    return policy.PACKS[name]


def load_policies(path: str) -> list[policy.Policy]:
    """Policies of a JSON file, by id."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("schema_version") != "1.0":
        raise ValueError(f"schema_version {data.get('schema_version')!r} is not 1.0")
    if errors := policy.validate(data.get("policies", [])):
        raise ValueError("; ".join(errors))
    return sorted(policy.Policy(p["id"], p["title"], p["severity"], p["type"], p["pattern"] if p["type"] == "regex" else p["needle"], p["description"], p.get("sample_limit", 3)) for p in data["policies"])


def load_mapping(path: str) -> dict[str, str]:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not all(isinstance(v, str) for v in data.values()):
        raise ValueError("a lexicon is an object of texts")
    return data


def pack_errors(pack: dict) -> list[str]:
    """What is wrong with a pack's description; empty if nothing is."""
    out = [f"missing key: {k}" for k in PACK_KEYS if k not in pack] + [f"unknown key: {k}" for k in sorted(set(pack) - set(PACK_KEYS))]
    if out:
        return out
    if pack["schema_version"] != VERSION:
        out.append(f"schema_version is not {VERSION}")
    if not isinstance(pack["pack_id"], str) or not re.fullmatch(r"[a-z0-9-]+", pack["pack_id"]):
        out.append("pack_id has other characters than a-z, 0-9 and -")
    out += [f"{k} is empty" for k in ("name", "description", "license", "language", "entries_path") if not isinstance(pack[k], str) or not pack[k].strip()]
    if pack["entry_format"] != "csv":
        out.append("entry_format is not csv")
    if ".." in str(pack["entries_path"]) or str(pack["entries_path"]).startswith("/"):
        out.append("entries_path leaves the pack")
    if not isinstance(pack["fields"], list) or not pack["fields"]:
        out.append("fields is no list with entries")
    else:
        for k, f in enumerate(pack["fields"]):
            if not isinstance(f, dict) or not {"name", "type", "required"} <= set(f):
                out.append(f"field {k} lacks name, type or required")
            elif f["type"] not in ("string", "integer", "boolean") or not isinstance(f["required"], bool) or not f["name"]:
                out.append(f"field {k} has an unknown type, no name, or a required that is no boolean")
    if not isinstance(pack["created_at_utc"], str) or not (pack["created_at_utc"].endswith("Z") or "+" in pack["created_at_utc"]):
        out.append("created_at_utc isn't in UTC")
    if not isinstance(pack["source_attribution"], list) or not all(isinstance(s, dict) and "name" in s for s in pack["source_attribution"]):
        out.append("source_attribution has an entry without a name")
    return out


def load_pack(folder: str) -> tuple[dict, list[dict], list[str]]:
    """A pack's description, its entries as declared columns, and errors (rows are numbered from 2)."""
    root = Path(folder)
    try:
        pack = json.loads((root / "pack.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        return {}, [], [f"pack.json: {e}"]
    if errors := pack_errors(pack):
        return pack, [], errors
    names, source = [f["name"] for f in pack["fields"]], root / pack["entries_path"]
    if not source.is_file():
        return pack, [], [f"no entries file {pack['entries_path']}"]
    with source.open(encoding="utf-8", newline="") as f:
        reader = csv.DictReader(f)
        if list(reader.fieldnames or []) != names:
            return pack, [], [f"columns mismatch: {reader.fieldnames} are not {names}"]
        entries = [{n: row.get(n) or "" for n in names} for row in reader]
    needed = [f["name"] for f in pack["fields"] if f["required"]]
    errors = [f"row {k}: {n} is empty" for k, e in enumerate(entries, 2) for n in needed if not e[n].strip()]
    return pack, entries, errors


def make_lock(folder: str, now: str) -> dict:
    pack, entries, errors = load_pack(folder)
    if errors:
        raise ValueError("; ".join(errors))
    names = [f["name"] for f in pack["fields"]]
    return {"lock_schema_version": VERSION, "generated_at_utc": now, "pack_id": pack["pack_id"], "pack_json_sha256": sha256((Path(folder) / "pack.json").read_bytes()), "entries_path": pack["entries_path"], "entries_sha256": entries_sha256(entries), "normalized_entries_sha256": normalized_sha256(entries), "entry_count": len(entries), "field_count": len(names), "fields_signature": fields_signature(names)}


def write_lock(folder: str, now: str) -> Path:
    out = Path(folder) / "pack.lock.json"
    out.write_text(pretty_json(make_lock(folder, now)), encoding="utf-8")
    return out


def verify_lock(folder: str) -> list[str]:
    """Fields of the lock that a new one would have otherwise (its time aside), or what is wrong with it."""
    try:
        lock = json.loads((Path(folder) / "pack.lock.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        return [f"pack.lock.json: {e}"]
    wrong = [f"missing key: {k}" for k in LOCK_KEYS if k not in lock] + [f"unknown key: {k}" for k in sorted(set(lock) - set(LOCK_KEYS))]
    if wrong or lock["lock_schema_version"] != VERSION:
        return wrong or [f"lock_schema_version is not {VERSION}"]
    try:
        new = make_lock(folder, lock["generated_at_utc"])
    except ValueError as e:
        return [str(e)]
    return [f"{k}: {lock[k]!r} is now {new[k]!r}" for k in LOCK_KEYS if lock[k] != new[k]]


def discover_packs(root: str) -> list[str]:
    return sorted(str(p.parent.relative_to(root)) for p in Path(root).rglob("pack.json"))


def discover(root: str) -> list[dict]:
    """Packs below root by path, with id, entry count, whether they have a lock, and errors."""
    out = []
    for name in discover_packs(root):
        pack, entries, errors = load_pack(os.path.join(root, name))
        out.append({"path": name, "pack_id": pack.get("pack_id"), "entry_count": len(entries), "has_lock": (Path(root) / name / "pack.lock.json").is_file(), "errors": errors})
    return out


def verify_all(root: str, fail_fast: bool = False) -> list[tuple[str, list[str]]]:
    out = []
    for name in discover_packs(root):
        out.append((name, verify_lock(os.path.join(root, name))))
        if fail_fast and out[-1][1]:
            break
    return out


def lock_gate(root: str) -> list[dict]:
    """Every pack below root with what its lock has against it: no lock, an unreadable one, a pack that can't be locked, or fields that a new lock would have otherwise."""
    out = []
    for name in discover_packs(root):
        has = (Path(root) / name / "pack.lock.json").is_file()
        out.append({"path": name, "problems": verify_lock(os.path.join(root, name)) if has else ["pack.lock.json is missing"]})
    return out


def write_receipt(folder: str, name: str, receipt: dict) -> list[Path]:
    """A receipt as readable JSON, as canonical JSON, and the canonical one's checksum line."""
    compact = json.dumps(receipt, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    paths = [Path(folder) / f"{name}{end}" for end in (".json", ".canonical.json", ".canonical.json.sha256")]
    paths[0].write_text(json.dumps(receipt, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    paths[1].write_text(compact, encoding="utf-8")
    paths[2].write_text(f"{hashlib.sha256(compact.encode()).hexdigest()}  {paths[1].name}\n", encoding="utf-8")
    return paths


def record(meta: Column, normalized: Column, redacted: Column) -> Column:
    """A cleaned text as a JSON line: meta, normalized (null if it wasn't asked for), redacted."""
    return F.to_json(F.struct(meta.alias("meta"), normalized.alias("normalized"), redacted.alias("redacted")), {"ignoreNullFields": "false"})


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of PDF files: page texts parted by blank lines; needs the optional package pypdf on the executors."""
    from textquarry.functions.text import normalized_extract

    def run(batches):
        import io

        import pypdf

        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                texts.append("\n\n".join(p for p in pages if p.strip()))
            yield pdf[["file"]].assign(text=texts)

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    return rows.mapInPandas(run, "file string, text string").withColumn("text", normalized_extract(F.col("text")))

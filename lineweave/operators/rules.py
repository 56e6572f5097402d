"""Rules over single lines of code: unsafe primitives, callback registrations and dispatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import any_of
from .slices import enclosing_functions

# What the rules look for.
IDENTITY = ("_id", "_key", "_hash", "_token", "cache", "session", "ident", "fingerprint")
SHELLS = ("subprocess.run(", "subprocess.Popen(", "subprocess.call(", "subprocess.check_call(", "subprocess.check_output(", "os.system(")
SHELL_ON = ("shell=True", "shell = True", "os.system(")
INTERPOLATED = ('f"', "f'", ".format(", " % ")
UNVERIFIED = ("verify=False", "verify = False", "ssl.CERT_NONE", "_create_unverified_context(", "CURLOPT_SSL_VERIFYPEER, 0", "CURLOPT_SSL_VERIFYHOST, 0", "check_hostname=False", "rejectUnauthorized: false", "InsecureSkipVerify: true")
SECRET = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth_key", "session_key")
PLACEHOLDERS = ("", "none", "null", "changeme", "changeit", "your-token", "your_token", "example", "placeholder", "xxx", "todo", "fixme")


def without_comment(text: Column, mark: str) -> Column:
    """The text before the first comment mark, wherever it stands."""
    return F.substring_index(text, mark, 1)


def truncated(code: Column) -> Column:
    n = lambda p: F.regexp_extract(code, p, 1).try_cast("long")
    return (n(r"hexdigest\(\)\[:([0-9]+)\]") < 32) | (n(r"\.digest\(\)\[:([0-9]+)\]") < 16)


def weak_identity(code: Column) -> Column:
    before = F.when(code.contains("hashlib.md5("), F.substring_index(code, "hashlib.md5(", 1)).when(code.contains("hashlib.sha1("), F.substring_index(code, "hashlib.sha1(", 1))
    target = F.trim(F.substring_index(before, "=", 1))
    return before.isNotNull() & any_of(F.lower(F.substring_index(target, ".", -1)), IDENTITY)


def hardcoded(code: Column) -> Column:
    name = F.regexp_extract(code, r"^\s*(?:[^=#\s]*\.)?([A-Za-z0-9_$]+)\s*(?::[^=]*)?=\s*(?:\"[^\"]+\"|'[^']+')", 1)
    body = F.regexp_extract(code, r"^[^=]*=\s*[\"']([^\"']*)", 1)
    return (name != "") & any_of(F.lower(name), SECRET) & ~F.lower(body).isin(*PLACEHOLDERS) & ~body.contains("${")


def rules(code: Column) -> dict[str, Column]:
    return {
        "HASH_TRUNCATED_BELOW_128_BITS": truncated(code),
        "WEAK_HASH_FOR_IDENTITY": weak_identity(code),
        "SHELL_TRUE_WITH_INTERPOLATION": any_of(code, SHELLS) & any_of(code, SHELL_ON) & any_of(code, INTERPOLATED),
        "CERT_VALIDATION_DISABLED": any_of(code, UNVERIFIED),
        "HARDCODED_SECRET": hardcoded(code),
    }


def primitives(source_lines: DataFrame, diff_lines: DataFrame, functions: DataFrame, comment: str = "#") -> DataFrame:
    """(file, line, rule, severity): lines that break a rule; concern on a diff line or in a function (innermost or not)
    with one, suggestion elsewhere."""
    code = without_comment(F.col("text"), comment)
    named = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules(code).items())), lambda x: x.isNotNull())
    found = source_lines.select("file", "line", F.explode(named).alias("rule"))
    diff = diff_lines.select("file", "line").distinct()
    dirty = enclosing_functions(diff, functions, every=True).select("file", "name", "start_line", "end_line").distinct()
    within = enclosing_functions(found.select("file", "line").distinct(), dirty, every=True).select("file", "line")
    near = within.unionByName(diff).distinct().withColumn("near", F.lit(True))
    return found.join(near, ["file", "line"], "left").select("file", "line", "rule", F.when(F.col("near"), "concern").otherwise("suggestion").alias("severity"))


def registrations(source_lines: DataFrame) -> DataFrame:
    """(file, line, field, function): callbacks put into a field, `x->f = g;`, `x.f = g;` or `.f = g,`."""
    p = r"(?:->|\.)([A-Za-z_][A-Za-z0-9_]*)\s*=\s*&?([A-Za-z_][A-Za-z0-9_]*)\s*[;,}]"
    rows = source_lines.select("file", "line", F.regexp_extract("text", p, 1).alias("field"), F.regexp_extract("text", p, 2).alias("function"))
    return rows.where("field <> ''")


def null_dispatches(source_lines: DataFrame) -> DataFrame:
    """(file, line, field): calls through a field with a null argument."""
    p = r"(?:->|\.)([A-Za-z_][A-Za-z0-9_]*)\s*\((?:[^()]*,\s*)?(?:NULL|nullptr|0)\s*[,)]"
    return source_lines.select("file", "line", F.regexp_extract("text", p, 1).alias("field")).where("field <> ''")


def dispatchers(source_lines: DataFrame, diff_lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, field, function, target_file): null dispatches, anywhere, of callbacks that a diff touches.

    A callback is touched if a diff line is in its body; target_file and function name it.
    """
    hit = enclosing_functions(diff_lines.select("file", "line").distinct(), functions).select(F.col("file").alias("target_file"), F.col("name").alias("function")).distinct()
    known = registrations(source_lines).select("field", "function").distinct().join(hit, "function")
    return null_dispatches(source_lines).join(known, "field").select("file", "line", "field", "function", "target_file")

"""One text for Spark SQL and DuckDB: what the two spell differently stands as ``$NAME(args)``."""

from __future__ import annotations

import re

# name: (Spark SQL, DuckDB); $1, $2 ... are the arguments.
FORMS = {
    "MILLIS": ("unix_millis(CAST($1 AS TIMESTAMP))", "(epoch_us($1) // 1000)"),
    "WORDS": ("explode(split(lower(trim($1)), ' +'))", "unnest(regexp_split_to_array(lower(trim($1)), ' +'))"),
    "SUB": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "SHA": ("sha2(encode($1, 'UTF-8'), 256)", "sha256($1)"),
    "JOINED": ("array_join(array_sort(collect_list($1)), $2)", "string_agg($1, $2 ORDER BY $1)"),
    "BYTES": ("octet_length($1)", "strlen($1)"),
    "MATCHES": ("($1 RLIKE $2)", "regexp_matches($1, $2)"),
    "DIV": ("CAST(floor($1 / $2) AS BIGINT)", "CAST(floor($1 / $2) AS BIGINT)"),
    "EACH": ("explode(sequence(CAST($1 AS BIGINT), CAST($2 AS BIGINT)))", "unnest(range(CAST($1 AS BIGINT), CAST($2 AS BIGINT) + 1))"),
    "NUMBER": ("try_cast($1 AS DECIMAL(38,8))", "try_cast($1 AS DECIMAL(38,8))"),
}


def render(text: str, duckdb: bool) -> str:
    while m := re.search(r"\$([A-Z]+)\(", text):
        depth, at, args, start = 1, m.end(), [], m.end()
        quoted = False
        while depth:
            c = text[at]
            if c == "'":
                quoted = not quoted
            elif not quoted and c == "(":
                depth += 1
            elif not quoted and c == ")":
                depth -= 1
            elif not quoted and c == "," and depth == 1:
                args.append(text[start:at].strip())
                start = at + 1
            at += 1
        args.append(text[start : at - 1].strip())
        form = FORMS[m[1]][duckdb]
        for k, a in enumerate(args, 1):
            form = form.replace(f"${k}", a)
        text = text[: m.start()] + form + text[at:]
    return text

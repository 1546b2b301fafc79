"""Readers of the driver tables and a small project of source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries by name with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return put


PROJECT = [
    (
        "src/app.ts",
        "import type { User, Session as Login } from './model/user';\nimport hash, { verify } from '../src/crypto';\nimport * as log from './log.js';\nimport React from 'react';\n"
        "import './side-effect';\nconst lazy = import('./model/user');\n\nexport async function signIn(name: string, secret: string): Promise {\n  if (!name || !secret) {\n    return deny(name);\n"
        "  } else if (name === 'root' && verify(secret)) {\n    for (const x of list()) {\n      log.info(x ? hash(x) : name);\n    }\n  }\n  return accept(name);\n}\n\nexport const limit: number = 5;\n"
        "const grow = (n: number) => {\n  while (n < limit) { n = step(n); }\n  return n;\n}\n",
    ),
    (
        "src/model/user.ts",
        "import { hash } from '../crypto';\nimport { Base } from '@acme/core/base';\n\nexport interface User {\n  name: string;\n}\nexport type Session = { user: User; started: number; tokens: string[] };\n"
        "export class Account extends Base implements Stored, Named {\n  open(name: string) {\n    this.check(name);\n    return hash(name);\n  }\n}\nclass Hidden {\n  run() {\n    return go();\n  }\n}\nexport { Account as Profile, Hidden };\n",
    ),
    ("src/crypto.ts", "const node = require('crypto');\nexport function hash(text: string): string {\n  return node.digest(text);\n}\nexport const verify = (text: string) => hash(text) !== '';\nexport default hash;\n"),
    ("src/log.js", "export function info(x) {\n  switch (x) {\n    case 1: print(x);\n    case 2: print(x || 0);\n  }\n}\n"),
    ("packages/core/package.json", '{"name": "@acme/core", "version": "1.0.0"}'),
    ("packages/core/base.ts", "export class Base {\n  check(name) {\n    return name;\n  }\n}\n"),
    ("tools/run.py", "import os\nfrom app.core import start\n\n@cached\ndef main(argv):\n    def inner():\n        return start()\n    return inner()\n\nclass Job:\n    async def go(self):\n        pass\n"),
    ("cmd/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"acme/core"\n)\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Start() error {\n\treturn nil\n}\n\nfunc main() {\n\tfmt.Println("}")\n}\n'),
    ("lib/mod.rs", "use std::fmt;\n\npub struct Point { x: i32 }\n\nimpl fmt::Display for Point {\n    fn fmt(&self) -> R { write() }\n}\n\npub enum Kind { A, B }\n\npub fn run() -> i32 { 1 }\n"),
    ("README.md", "# Title\n"),
    ("src/empty.ts", ""),
    ("src/comment.ts", "// only words\n/* and more */\n"),
]


def project(spark: SparkSession) -> DataFrame:
    """The twelve files above, as one project."""
    return spark.createDataFrame(PROJECT, "filepath string, content string")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: twelve of them in a row make a project in a folder of its own, with a package of its own.

    The document's number and language stand in each file, and its text decides how many copies of a
    line of code end it.
    """
    given = spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(PROJECT)], "k int, path string, body string")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(F.length("text") % 4, F.lit(0)).cast("int").alias("n"))
    number = F.expr("doc_id div 12").cast("string")
    rows = docs.withColumn("k", (F.col("doc_id") % 12).cast("int")).join(F.broadcast(given), "k")  # twelve rows
    body = F.replace("body", F.lit("@acme/core"), F.concat(F.lit("@acme/core"), number))
    code = (F.col("path").rlike("[.][jt]s$")) & (F.col("body") != "")
    more = F.when(code, F.repeat(F.concat(F.lit("export function own"), F.col("doc_id").cast("string"), F.lit("(a: "), F.coalesce("lang", F.lit("any")), F.lit("): Text {\n  return a && read(a);\n}\n")), F.col("n"))).otherwise(F.lit(""))
    return rows.select(F.concat(F.lit("p"), number, F.lit("/"), "path").alias("filepath"), F.concat(body, more).alias("content"), "doc_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROJECT_SQL = (
    "given(k, path, body) AS (VALUES " + ", ".join(f"({k}, {quoted(p)}, {quoted(c)})" for k, (p, c) in enumerate(PROJECT)) + "), "
    "files AS (SELECT 'p' || (doc_id // 12) || '/' || path AS filepath, replace(body, '@acme/core', '@acme/core' || (doc_id // 12)) || CASE WHEN regexp_matches(path, '[.][jt]s$') AND body <> '' "
    "THEN repeat('export function own' || doc_id || '(a: ' || coalesce(lang, 'any') || '): Text {' || chr(10) || '  return a && read(a);' || chr(10) || '}' || chr(10), coalesce(length(text) % 4, 0)) ELSE '' END AS content, doc_id FROM documents JOIN given ON k = doc_id % 12)"
)
LINES_SQL = PROJECT_SQL + ", lines AS (SELECT filepath, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"

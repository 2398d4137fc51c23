"""Source texts made from the documents, alike in Spark and in SQL.

The tables hold prose.  Here every line of a document becomes a line of code in one of the nine
languages: the language follows the document, the kind of line its number, names and comments
its words.  So queries about comments, names, heads, hints and exceptions meet all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from authorlens.functions.text import LETTERS, let, lines_of

# Kinds of lines. {w} is the line's first word, {s} its letters and blanks, {n} its number.
TEMPLATES = {
    "python": ["# {s}", "import {w}_tools", "def {w}_total(first_value, {w}Count):", '    """{s}"""', "    if first_value >= {n}:",
               '        raise ValueError("{w}")', "    for i in range({n}):", "\tself.{w}_list = first_value+{n}  ", "    try:",
               "    except KeyError as e:", "", "    return {w}_total == {n}", "def {w}(a: int) -> str:", '    """{w}', "    {s}", "", '    """'],
    "javascript": ["// {s}", "const {w}Count = {n};", "function {w}Total(a, b) {", "  if (a===b) {", '    console.log("{w}");', "  }",
                   "  for (let i = 0; i < {n}; i++) {", "\tx = a<=b != c; ", "  }", "}", "/* {s} */", "const {w}Map = (a) => { return a; };", ""],
    "typescript": ["// {s}", "interface {w}Shape {", "  {w}: string;", "}", "/** {s} */", "class {w}Box {", "  go(a: number): void {",
                   "    while (a <= {n}) { a++; }", "  }", "}", "", "export const {w}s: boolean = true;"],
    "java": ["/**", " * {s}", " */", "public class {w}Box {", "  public static void main(String[] args) {", '    System.out.println("{w}");',
             "    if (a != {n}) {", '      throw new IllegalStateException("{w}");', "    }", "  }", "}", "// {s}", "    } catch (Exception failure) {"],
    "c": ["#include <stdio.h>", "int {w}_count = {n};", "int main(void) {", '  printf("%d", {n});', "  while (n<= {n}) { n++; }", "  return 0;", "}",
          "// {s}", "/* {s} */", "struct {w}_box { int a; };", "", "\tint measured_{w}_values = {n};\t"],
    "cpp": ["#include <vector>", "using namespace std;", "template <typename T>", "class {w}Box {", "  std::vector<int> {w}s;", "  string name;",
            "  void show() { cout << {n}; }", "};", "// {s}", "/** {s} */", ""],
    "go": ["package {w}s", "func {w}Sum(a int) int {", "  fmt.Println(a)", "  if a == {n} { return a }", "  for a < {n} { a++ }", "}", "// {s}", "/* {s} */", ""],
    "rust": ["fn {w}_sum(a: i32) -> i32 {", "  let mut {w} = {n};", '  println!("{w}");', "  match a { _ => {n} }", "}", "/// {s}", "// {s}",
             "struct {w}Box;", "use std::io;", ""],
    "ruby": ["def {w}_sum(a)", "  puts a", "  if a == {n}", "    return a", "  end", "end", "# {s}", "=begin", "{s}", "=end", "class {w}Box", ""],
}
_PART = re.compile(r"\{[wsn]\}")


def _pieces(template: str) -> list[str]:
    """A template cut into plain text and places."""
    return [p for p in re.split(r"(\{[wsn]\})", template) if p]


def code_of(code: Column, id_: Column) -> Column:
    """The lines of a document as code, by the rules above.

    A line's template is picked first and filled then, so a line costs one template and not all of them.
    Words, letters and digits hold no braces, so one place filled never looks like another.
    """
    kinds = F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in TEMPLATES.values()])
    sizes = F.array(*[F.lit(len(ts)) for ts in TEMPLATES.values()])
    place = (id_ % len(TEMPLATES)).cast("int")

    def line(text: Column, i: Column) -> Column:
        def filled(template: Column) -> Column:
            # a line without letters has the word x
            word = F.lower(F.regexp_extract(F.concat(text, F.lit(" x")), "[A-Za-z]+", 0))
            words = F.when(F.contains(template, F.lit("{s}")), F.regexp_replace(text, f"[^{LETTERS} ]+", "")).otherwise(F.lit(""))
            made = template
            for part, value in (("{w}", F.when(F.contains(template, F.lit("{w}")), word).otherwise(F.lit(""))), ("{s}", words), ("{n}", (i + 1).cast("string"))):
                made = F.replace(made, F.lit(part), value)
            return made
        return let(F.get(F.get(kinds, place), ((i + 1 + id_) % F.get(sizes, place)).cast("int")), filled)
    return F.concat(F.array_join(F.transform(lines_of(code), line), "\n"), F.lit("\n"))


def code_texts(documents: DataFrame) -> DataFrame:
    """``(id, code)`` of the documents as code; ``id`` is a number."""
    return documents.select("id", code_of(F.col("code"), F.col("id")).alias("code"))


def code_sql(lines: str) -> str:
    """The same over a subquery ``(id, n, line)`` of numbered lines and its documents."""
    def made(templates: list[str]) -> str:
        kinds = [" || ".join([{"{w}": "w", "{s}": "s", "{n}": "n::VARCHAR"}.get(p) or _text(p) for p in _pieces(t)]) or "''" for t in templates]
        return f"CASE (n + id) % {len(templates)} " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"
    lang = f"CASE id % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {made(t)}" for i, t in enumerate(TEMPLATES.values())) + " END"
    words = "lower(coalesce(nullif(regexp_extract(line, '[A-Za-z]+'), ''), 'x'))"
    return (f"(SELECT d.doc_id AS id, coalesce(string_agg(made, chr(10) ORDER BY n), '') || chr(10) AS code FROM documents d LEFT JOIN (SELECT id, n, {lang} AS made FROM "
            f"(SELECT id, n, {words} AS w, regexp_replace(line, '[^A-Za-z ]', '', 'g') AS s FROM {lines} c0) c1) c2 ON c2.id = d.doc_id GROUP BY d.doc_id)")


def _text(plain: str) -> str:
    parts = [f"'{p}'" for p in plain.replace("'", "''").split("\t")]
    return " || chr(9) || ".join(parts)

"""Prompt builders (P1-P8) as column expressions.

Each prompt is a template: a list of literal strings, column references and
optional sections. ``to_column`` renders it as a Spark ``concat``; ``to_sql``
renders the same template as SQL for the oracle, so the two cannot drift.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Opt:
    """Section emitted only when ``name`` is a non-empty string."""
    name: str
    parts: tuple


@dataclass(frozen=True)
class Flag:
    """Section emitted only when boolean ``name`` is true."""
    name: str
    parts: tuple


@dataclass(frozen=True)
class Pick:
    """One of several sub-templates chosen by the value of ``name``."""
    name: str
    cases: tuple  # ((value, parts), ...)
    default: tuple


def to_column(parts) -> Column:
    cols = []
    for p in parts:
        if isinstance(p, str):
            cols.append(F.lit(p))
        elif isinstance(p, Col):
            cols.append(F.col(p.name))
        elif isinstance(p, Opt):
            c = F.col(p.name)
            cols.append(F.when(c.isNotNull() & (F.length(c) > 0), to_column(p.parts)).otherwise(F.lit("")))
        elif isinstance(p, Flag):
            cols.append(F.when(F.col(p.name), to_column(p.parts)).otherwise(F.lit("")))
        elif isinstance(p, Pick):
            expr = None
            for value, sub in p.cases:
                cond = F.col(p.name) == F.lit(value)
                expr = F.when(cond, to_column(sub)) if expr is None else expr.when(cond, to_column(sub))
            cols.append(expr.otherwise(to_column(p.default)))
        else:
            raise TypeError(p)
    return F.concat(*cols) if cols else F.lit("")


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def to_sql(parts) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(_sql_lit(p))
        elif isinstance(p, Col):
            out.append(p.name)
        elif isinstance(p, Opt):
            out.append(f"(CASE WHEN {p.name} IS NOT NULL AND length({p.name}) > 0 THEN {to_sql(p.parts)} ELSE '' END)")
        elif isinstance(p, Flag):
            out.append(f"(CASE WHEN {p.name} THEN {to_sql(p.parts)} ELSE '' END)")
        elif isinstance(p, Pick):
            whens = " ".join(f"WHEN {p.name} = {_sql_lit(v)} THEN {to_sql(sub)}" for v, sub in p.cases)
            out.append(f"(CASE {whens} ELSE {to_sql(p.default)} END)")
        else:
            raise TypeError(p)
    return "(" + " || ".join(out) + ")" if out else "''"


# ----------------------------------------------------------------- texts ----
EDIT_BLOCK_HINT = (
    "\n\nFor every fix you propose, add an edit block in exactly this form:\n"
    "<<<< SEARCH file:<path>\n<lines to find>\n==== REPLACE\n<new lines>\n>>>>"
)

_CONTEXT = {
    "review": Opt("context", ("\n\nRepository code related to the change:\n", Col("context"))),
    "audit": Opt("context", ("\n\nCode elsewhere that calls or feeds it:\n", Col("context"))),
}

SYSTEM = {
    "commit": "You write git commit messages: one conventional-commit subject line of at most "
              "72 characters, a blank line, then a few short bullet points. Reply with the message only.",
    "review": "You are a senior code reviewer. Point out bugs, risky changes, code smells and design "
              "problems, most important first, each with a concrete suggestion.",
    "audit": "You are an application security auditor. Look for injection, broken access control, "
             "secrets and sensitive data exposure, unsafe configuration and other common weakness "
             "classes. Report each finding on one line as: [Severity] - [File/Line] - [Description] - "
             "[Remediation], with a severity of Critical, High, Medium or Low. Skip lines marked with an "
             "ignore-sec comment. If there is nothing to report, answer NO_VULNERABILITIES_FOUND only.",
    "doc": "You write clear Markdown documentation that follows the Diataxis framework.",
    "test": "You write thorough, runnable unit tests.",
    "summary": "You summarise source files for an architecture review.",
    "architect": "You are a software architect reviewing a whole repository.",
    "ask": "You answer questions about a codebase using only the excerpts given. Say so when the "
           "excerpts do not contain the answer.",
}

DOC_TEMPLATES = (
    ("tutorial", ("Write a tutorial: a guided, hands-on lesson that takes a newcomer from nothing "
                  "to a working result.",)),
    ("howto", ("Write a how-to guide: numbered steps that solve one concrete task for a reader "
               "who knows the basics.",)),
    ("reference", ("Write reference documentation: a precise and complete description of every "
                   "public item with its parameters and results.",)),
    ("explanation", ("Write an explanation: the background, design decisions and trade-offs that "
                     "show why the code is shaped this way.",)),
)
_DOC_DEFAULT = DOC_TEMPLATES[2][1]

USER = {
    # The diff itself
    "commit": (Col("diff"),),
    # Diff; context (nullable) and fix (bool) are in the system text, in this order
    "review": ("Review this change set.\n\n", Col("diff")),
    # Code; fix and context are in the system text, in this order
    "audit": ("Audit this code.\n\n", Col("code")),
    # partial answers of one job, in order
    "merge": ("Combine these partial results into one result, keeping every point once.\n\n", Col("parts")),
    # doc_type, language, code, hint (nullable), existing (nullable)
    "doc": (Pick("doc_type", DOC_TEMPLATES, _DOC_DEFAULT),
            "\nLanguage: ", Col("language"),
            Opt("hint", ("\nNote from the author: ", Col("hint"))),
            Opt("existing", ("\n\nThe current document follows; keep what is still right and "
                             "update the rest.\n\n", Col("existing"))),
            "\n\nSource:\n", Col("code")),
    # P5: framework, language, code, existing (nullable), context (nullable)
    "test": (Pick("mode", (("update", ("Update the existing ", Col("framework"), " tests in ",
                                       Col("language"), " so they match the code; keep tests that "
                                       "still hold.\n\nExisting tests:\n", Col("existing"),
                                       "\n\nCode:\n", Col("code"))),),
                  ("Write ", Col("framework"), " unit tests in ", Col("language"),
                   " for the code below, covering normal cases, edge cases and errors. Reply with "
                   "the test file only.\n\n", Col("code"))),
             Opt("context", ("\n\nRelated definitions:\n", Col("context")))),
    # content
    "summary": ("Summarise the purpose, main parts and dependencies of this file in a few "
                "sentences.\n\n", Col("content")),
    # Tree, summaries
    "architect": ("Assess the architecture of this repository: structure, layering, coupling, "
                  "risks and concrete improvements.\n\nFiles:\n", Col("tree"),
                  "\n\nFile summaries:\n", Col("summaries")),
    # Context, question
    "ask": ("Excerpts:\n", Col("context"), "\n\nQuestion: ", Col("question")),
}


# Sections after the fixed system text of the change set and audit prompts.
SECTIONS = {
    "review": (_CONTEXT["review"], Flag("fix", (EDIT_BLOCK_HINT,))),
    "audit": (Flag("fix", (EDIT_BLOCK_HINT,)), _CONTEXT["audit"]),
}
# Route (J10) of each kind of prompt.
ROUTE = {"commit": "fast", "summary": "fast", "review": "review", "audit": "review", "doc": "coding", "test": "coding",
         "architect": "default", "ask": "default"}


def system(kind: str, sections: bool = True) -> Column:
    return to_column((SYSTEM[kind], *(SECTIONS.get(kind, ()) if sections else ())))


def user(purpose: str) -> Column:
    return to_column(USER[purpose])


def user_sql(purpose: str) -> str:
    return to_sql(USER[purpose])


def system_sql(kind: str, sections: bool = True) -> str:
    return to_sql((SYSTEM[kind], *(SECTIONS.get(kind, ()) if sections else ())))

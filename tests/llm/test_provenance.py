import random

from semantide.llm.provenance import NOTICE, ORIGIN, _automaton, _kinds, generated_notice, not_hand_written, origin, weigh

HAND = "\n".join(f"def step_{k}(a, b):\n    total = a * {k} + b\n    if total > {k * 7}:\n        return helper_{k}(total)\n    return [x for x in range(total) if x % {k + 2}]\n" for k in range(12))


def test_notices_and_what_only_looks_like_one():
    for text in (
        "# Code generated by protoc-gen 1.2. DO NOT EDIT.\nx = 1\n",
        "/* @generated */\nint x;\n",
        "// This file was automatically generated by flexy from a.l\n// Any manual change will be lost.\nint x;\n",
        "# AUTOGENERATED KEY TABLE - regenerate with `make keys`\n",
        "/* -*- buffer-read-only: t -*- */\n",
        "# Automatisch erzeugt durch tool 1.0, nicht bearbeiten\n",
    ):
        assert generated_notice(text), text
    for text in (
        "# Do not edit the list by hand while the loop runs\nx = 1\n",
        "# auto-generated lane values are checked in f\n",
        "# builds the file that cmake generated; see f\n",
        'out.write("# Code generated by x. DO NOT EDIT.\\n")\n',
        "# minified code goes to dist\n",
    ):
        assert not generated_notice(text), text


def test_origin_names_an_outside_project_only():
    assert origin("/*\n * Copyright (c) 2019 The Foo Project\n */\nint x;", "mine-kit") == "foo"
    assert origin("# This file is part of bar (release 1.2.3).\n", "mine-kit") == "bar"
    assert origin("# Imported unchanged from upstream baz, revision abc123.\n", None) == "baz"
    assert origin("__version__ = '1.2'  # qux upstream\n", None) == "qux"
    assert origin("# Copyright (c) 2019 the mine-kit team\n", "mine-kit") is None
    assert origin("# This file is part of mine-kit (release 1.0).\n", "mine-kit") is None
    assert origin("# third party prices are billed by order\n", None) is None


def test_every_pattern_has_its_cues():
    generated = """@generated; Code generated from a.x; machine-made; machine written; buffer-read-only: t; This file was generated with protoc; file is emitted by x; this module has been produced from y
this code was created automatically with z; auto-produced by x; automatically created, do not; autogenerated table - regenerate; written by x, edits lost; made by x, hands off; Manual changes are discarded
changes will be undone; edits get lost; local modifications will be overwritten; Never touch this file.; do not change this file.; don't modify; automatisch erstellt; générée automatiquement; generada automáticamente
gerada automaticamente; generato automaticamente; сгенерировано автоматически; создано автоматически; автоматически создан; автоматически сгенерирован; 自动生成 请勿; 自動生成 編集; 不要编辑""".replace("\n", "; ").split("; ")
    origins = """this file is part of foo; copyright 2019 the foo foundation; (c) 2001 foo contributors; copied verbatim from zlib v1.2; Synced from libfoo at 3f2a; pulled from foo, revision 1; derived from foo commit 1
taken from foo 12; unchanged from foo; @license see foo/x; part of the foo toolkit; libfoo, version 1; copyright 2019 jane and foo contributors; originally from https://example.org/jane/foo; interface of the "foo" library; foo 1.2 - lists for everyone; foo is free software; __version__ = '1'  # foo upstream; #define FOO_VERSION_STRING""".replace("\n", "; ").split("; ")
    quick, cues = _automaton()
    for p in ORIGIN:
        assert any(p.search(t) for t in origins), p.pattern
    for t in origins:
        assert any(p.search(t) for p in ORIGIN), t
        assert _kinds(quick, f"# {t}\n") & 2, t
    for t in generated:
        assert _kinds(quick, f"# {t}\n") & 1, t
        assert weigh(t, True, cues) >= NOTICE, t


def test_notices_of_public_tools():
    # As these tools write them.
    notices = [
        "/* A Bison parser, made by GNU Bison 3.0.4.  */\n", "/* Generated by Cython 0.29.21 */\n", "# Generated by Django 4.2 on 2023-05-01 10:00\n", "# Form implementation generated from reading ui file 'main.ui'\n#\n# Created by: PyQt5 UI code generator 5.15\n",
        "/* Generated by re2c 1.0.3 on Mon Jan 1 00:00:00 2018 */\n", "/* C code produced by gperf version 3.1 */\n/* Command-line: gperf x.gperf  */\n", "import x\n\ndef upgrade():\n    # ### commands auto generated by Alembic - please adjust! ###\n    pass\n",
        "/* This file was automatically generated by SWIG (http://www.swig.org).\n * Version 3.0.12\n * Do not make changes to this file unless you know what you are doing */\n", "# -*- coding: utf-8 -*-\n# Generated by the protocol buffer compiler.  DO NOT EDIT!\n# source: a.proto\n",
        "/* A lexical scanner generated by flex */\n", "# parsetab.py\n# This file is automatically generated. Do not edit.\n_tabversion = '3.10'\n", "# Autogenerated by Thrift Compiler (0.13.0)\n#\n# DO NOT EDIT UNLESS YOU ARE SURE THAT YOU KNOW WHAT YOU ARE DOING\n",
        "// Generated from Expr.g4 by ANTLR 4.9\n", "/* Meta object code from reading C++ file 'a.h'\n** Created by: The Qt Meta Object Compiler version 67\n** WARNING! All changes made in this file will be lost! */\n", "/* DO NOT EDIT THIS FILE - it is machine generated */\n",
    ]
    for text in notices:
        assert generated_notice(text), text
    remarks = [
        "# Reads the tokens generated by the lexer.\nx = 1\n", "# Written by Jane Doe, 2019\nx = 1\n", "/* Created by J. Doe on 3/4/2020. */\nint x;\n", "x = 1\n# ids are generated by the server\n", "# The auto-generated keys are sorted before use\n", "// Original by X. Do not modify the returned list\nint x;\n",
        "x = 1  # do not change the order of these\n", "def f():\n    # machine-made parts are skipped\n    pass\n", "# unsaved changes: ask the user\nx = 1\n", "x = 1\n# pending changes will be lost on exit\n", "# This module generates code for the parser\nx = 1\n",
    ]
    for text in remarks:
        assert not generated_notice(text), text
    for text, name in (
        ("/* zlib.h -- interface of the 'zlib' general purpose compression library\n  version 1.2.11, January 15th, 2017 */\n", "zlib"), ("/*\n  Copyright (c) 2009-2017 Dave Gamble and cJSON contributors\n*/\n", "cjson"),
        ("// Originally from https://github.com/someone/tinyexpr\n", "tinyexpr"), ("/* stb_image - v2.27 - public domain image loader */\n", "stb_image"), ("# Taken from https://example.org/a/b/blob/main/x.py\n", "b"),
    ):
        assert origin(text, "mine-kit") == name, text


def test_notices_without_the_usual_words_are_found_in_tables(spark):
    notices = ["This file was generated with protoc", "Manual changes are discarded", "Never touch this file.", "Synced from libfoo at 3f2a", "copied verbatim from zlib v1.2", "plain remark"]
    rows = [(k, f"# {t}\nx = {k}\n", "r", f"{k}.py", f"{k}.py") for k, t in enumerate(notices)]
    df = spark.createDataFrame(rows, "k long, code string, repo string, path string, name string")
    out = {r["id"]: r["reason"] for r in not_hand_written(df, "k", "code", "repo", "path", "name").collect()}
    assert out == {0: "generated", 1: "generated", 2: "generated", 3: "vendored", 4: "vendored"}


def test_table_form_with_copies_and_edge_cases(spark):
    rng = random.Random(3)
    notice = "# Imported unchanged from upstream foo, revision 12ab.\n\n"
    edited = HAND.replace("total > 35", "total > 36")
    data = "T = [" + ", ".join(str(rng.random()) for _ in range(300)) + "]\n"
    mini = "".join(f"def a{k}(b,c=2):d=b*{k}^c;c+=[1,2][b%2];return d\n" for k in range(3)) + ";".join(f"e{k}=a1({k},f)" for k in range(120)) + "\n"
    table = "\n".join(f"def _p_{k}(p):\n    p[0] = _node({rng.randint(1, 999)}, p[1], p[2])\n" for k in range(40))
    rows = [
        (1, notice + HAND, "r", "lib/a.py", "a.py"), (2, edited, "s", "src/b.py", "b.py"), (3, data, "s", "c.py", "c.py"), (4, mini, "s", "d.py", "d.py"), (5, table, "s", "e.py", "e.py"),
        (6, "# @generated by x on run 3\nX = 1\n", None, None, "f.py"), (7, None, "s", "vendor/foo/x.py", "x.py"), (8, "", "s", "g.py", "g.py"), (9, "int main(void) { return 0; }\n", "s", "vendor/h.c", "h.c"),
        (10, "x = 1\n", "s", "third_party/foo/i.py", "i.py"), (11, "y = 2\n", "s", "third_party/nobody/j.py", "j.py"),
    ]
    df = spark.createDataFrame(rows, "k long, code string, repo string, path string, name string").selectExpr("*", "1 AS id", "'z' AS reason")
    out = {r["id"]: (r["reason"], r["project"]) for r in not_hand_written(df, "k", "code", "repo", "path", "name").collect()}
    assert out == {1: ("vendored", "foo"), 2: ("vendored copy", "foo"), 3: ("payload", None), 4: ("minified", None), 5: ("generated", None), 6: ("generated", None), 10: ("vendored", "foo")}
    assert not_hand_written(df.where("k < 0"), "k", "code", "repo", "path", "name").count() == 0

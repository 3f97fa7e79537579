"""One text in which each rule fires, and one like it in which it doesn't."""

ARMS9 = "fn f(x: i32) -> i32 { match x { " + " ".join(f"{i} => {i}," for i in range(9)) + " } }"
CASES = [
    ("ascii-separator", "rs", "// ==========\nfn f() {}", "// plain words\nfn f() {}"),
    ("ascii-separator", "py", "# --- Title ---\nx = 1", "# Title\nx = 1"),
    ("boolean-parameter", "rs", "fn f(a: i32, on: bool) {}", "fn f(a: i32) {}"),
    ("boolean-parameter", "ts", "function f(on: boolean) {}", "function f(on: string) {}"),
    ("deep-nesting", "rs", "fn f() { if a { for b in c { while d { if e { g(); } } } } }", "fn f() { if a { for b in c { while d { g(); } } } }"),
    ("deep-nesting", "py", "if a:\n  for b in c:\n    while d:\n      if e:\n        g()\n", "if a:\n  for b in c:\n    g()\n"),
    ("deep-super-import", "rs", "use super::super::a;", "use super::a;"),
    ("deeply-nested-type", "rs", "fn f(a: Vec<Option<Box<u8>>>) {}", "type A = Vec<Option<Box<u8>>>; fn f(a: Vec<Option<u8>>) {}"),
    ("deprecation-marker", "rs", "// deprecated since 2\nfn f() {}", "// current\nfn f() {}"),
    ("else-if-chain", "rs", "fn f() { if a { } else if b { } else if c { } else if d { } }", "fn f() { if a { } else if b { } else if c { } else { } }"),
    ("else-if-chain", "py", "if a:\n  x()\nelif b:\n  y()\nelif c:\n  z()\nelif d:\n  w()\n", "if a:\n  x()\nelif b:\n  y()\n"),
    ("empty-catch", "ts", "try { f(); } catch (e) { /* no */ }", "try { f(); } catch (e) { g(e); }"),
    ("fat-trait", "rs", "trait T { " + " ".join(f"fn m{i}(&self);" for i in range(9)) + " }", "trait T { " + " ".join(f"fn m{i}(&self) {{}}" for i in range(9)) + " }"),
    ("god-struct", "rs", "struct S { " + ", ".join(f"f{i}: u8" for i in range(11)) + " }", "struct S { " + ", ".join(f"f{i}: u8" for i in range(10)) + " }"),
    ("index-in-loop", "rs", "fn f(v: &[u8]) { for i in 0..v.len() { g(v[i]); } }", "fn f(v: &[u8]) { for x in v { g(x); } }"),
    ("index-in-loop", "py", "for i in range(len(v)):\n    g(v[i])\n", "for x in v:\n    g(x)\n"),
    ("large-closure", "rs", "fn f() { let g = || {\n" + "h();\n" * 16 + "}; }", "fn f() { let g = || {\n" + "h();\n" * 3 + "}; }"),
    ("long-match", "rs", ARMS9, ARMS9.replace("8 => 8,", "")),
    ("long-parameter-list", "rs", "fn f(a: u8, b: u8, c: u8, d: u8, e: u8, g: u8) {}", "fn f(a: u8, b: u8, c: u8, d: u8, e: u8) {}"),
    ("magic-number", "rs", "fn f() { g(a + 42); }", "const A: u8 = 42; fn f() { g(v[42]); }"),
    ("magic-string", "rs", 'fn f() { if a == "admin" { g(); } }', 'const A: &str = "admin"; fn f() { g("admin"); }'),
    ("manual-map", "rs", "fn f() { match a { Some(x) => Some(x + 1), None => None } }", "fn f() { match a { Some(x) => x, None => 0 } }"),
    ("negated-condition", "rs", "fn f() { if !a { b(); } else { c(); } }", "fn f() { if !a { b(); } }"),
    ("negated-condition", "ts", "if (!a) { b(); } else { c(); }", "if (a) { b(); } else { c(); }"),
    ("redundant-clone", "rs", "fn f() { let b = a.clone(); g(b); }", "fn f() { let b = a.clone(); g(b, a); }"),
    ("repeated-field-access", "rs", "fn f() { self.a.b(); self.a.c(); self.a.d(); }", "fn f() { self.a.b(); x.y.c(); self.a.d(); }"),
    ("single-use-variable", "rs", "fn f() { let a = g(); h(a); }", "fn f() { let a = g(); h(a); k(a); }"),
    ("string-concat-loop", "rs", 'fn f() { for a in b { s += "x"; } }', "fn f() { for a in b { n += 1; } }"),
    ("string-concat-loop", "py", 'for a in b:\n    s = s + "x"\n', 'for a in b:\n    s = "x"\n'),
    ("string-format-push", "rs", 'fn f() { s.push_str(&format!("{}-{}", a, b)); }', 'fn f() { s.push_str(&format!("{a}")); }'),
    ("stringly-typed-match", "rs", 'fn f() { match a { "x" => 1, "y" => 2, "z" => 3, _ => 4 } }', 'fn f() { match a { "x" => 1, B => 2, C => 3, _ => 4 } }'),
    ("stringly-typed-match", "ts", 'switch (a) { case "x": f(); case "y": g(); case "z": h(); }', "switch (a) { case 1: f(); case 2: g(); case 3: h(); }"),
    ("todo-fixme", "rs", "// TODO: do it\nfn f() {}", "// the TODO list\nfn f() {}"),
    ("todo-fixme", "py", "# FIXME(me): now\n", "# fixed\n"),
    ("too-many-locals", "rs", "fn f() { " + " ".join(f"let a{i} = {i};" for i in range(11)) + " }", "fn f() { " + " ".join(f"let a{i} = {i};" for i in range(10)) + " }"),
    ("too-many-methods", "rs", "impl S { " + " ".join(f"fn m{i}() {{}}" for i in range(16)) + " }", "impl S { " + " ".join(f"fn m{i}() {{}}" for i in range(15)) + " }"),
    ("type-in-variable-name", "rs", "fn f() { let name_str = 1; }", "fn f() { let name = 1; }"),
    ("unnecessary-else", "rs", "fn f() { if a { return 1; } else { b(); } }", "fn f() { if a { b(); } else { return 1; } }"),
    ("unnecessary-else", "py", "def f():\n    if a:\n        return 1\n    else:\n        b()\n", "def f():\n    if a:\n        b()\n    else:\n        c()\n"),
    ("unwrap-chain", "rs", "fn f() { a().unwrap().b().unwrap(); }", "fn f() { a().unwrap(); b().unwrap(); }"),
]

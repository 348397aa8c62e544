"""Answers over a small sample workspace and of the text functions, as rows."""

from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from callweft.functions import text as tx
from callweft.plans import sample
from callweft.plans.graph import CodeGraph, entry_first, trace_stats

CASES = {}


@lru_cache(maxsize=1)
def sample_graph(spark) -> CodeGraph:
    return CodeGraph(sample.frame(spark))


def query(columns, rows):
    """Register a question with the rows that it has to give."""

    def register(f):
        CASES[f.__name__] = (f, columns.split(", "), rows)
        return f

    return register


@query("caller, target, via, args", [
    ("bigsquare#area", "bigsquare#area", "override", ""), ("bigsquare#area", "square#area", "super", ""), ("bigsquare#area", "square#side", "this", ""),
    ("donetrigger#(trigger)", "saver#save", "static", ""), ("drawing#make", "drawing#<init>", "new", ""), ("drawing#add", "bigsquare#area", "interface", ""),
    ("drawing#add", "square#area", "interface", ""), ("drawing#add", "shape#area", "typed", ""), ("drawing#show", "square#<init>", "new", ""),
    ("drawing#show", "drawing#make", "static", ""), ("drawing#show", "drawing#add", "typed", "s: new Square()"), ("drawing#show", "drawing#show", "typed", ""),
    ("drawing#guess", "square#side", "narrowed", ""), ("drawing#guess", "lonely#onlyhere", "unique-name", "n: 1"), ("drawing.part#touch", "drawing#make", "static", ""),
    ("invoicehandler#run", "billing#<init>", "new", ""), ("invoicehandler#run", "billing#charge", "typed", "acct: acctId, amount: 10.5"),
    ("invoicehandler#run", "billing#audit", "static", ""), ("invoicehandler#run", "invoicehandler#step", "this", "s: 'a, (b)'"),
    ("invoicehandler#step", "billing#charge", "typed", "acct: s, amount: 1"), ("invoicetrigger#(trigger)", "invoicehandler#<init>", "new", ""),
    ("invoicetrigger#(trigger)", "invoicehandler#run", "typed", ""), ("lonely#onlyhere", "ext.gateway#ping", "external", "n"),
    ("saver#save", "invoicetrigger#(trigger)", "dml", "inv"), ("saver#save", "invoicetrigger#(trigger)", "dml", "many"), ("saver#save", "job#execute", "async", "c: new Job()"),
    ("saver#save", "job#<init>", "new", ""), ("saver#save", "donetrigger#(trigger)", "publish", "new Done__e()"), ("saver#save", "lonely#<init>", "dynamic", "name"),
    ("saver#save", "saverexception#<init>", "new", "'no'"), ("saver#save", "saverexception#(exception)", "throws", ""), ("saver#fromflow", "saver#save", "this", ""),
    ("savertest#works", "saver#save", "static", ""), ("square#area", "square#side", "this", ""), ("account2#(get total)", "account2#count", "this", ""), ("account2#(set total)", "account2#audit", "this", "v: value"),
    ("account2#use", "account2#(set total)", "typed", "value: value"), ("account2#use", "account2#(get total)", "typed", ""), ("saver#save", "flow:nightly#(file)", "dml", "insert"),
    ("saver#save", "flow:nightly#(file)", "dml", "insert"), ("flow:nightly#(file)", "flow:child#(file)", "subflow", ""),
    ("flow:child#(file)", "ns.thing#(class)", "external", ""),
])
def code_edges(spark):
    e = sample_graph(spark).edges.filter("via <> 'metadata'")
    return e.select(F.concat_ws("#", "caller_class", "caller_method").alias("caller"), F.concat_ws("#", "target_class", "target_method").alias("target"), "via", F.col("args_rendered").alias("args"))


@query("depth, node, parent, state", [
    (0, "saver#save", "", "expanded"), (1, "aura:box#(file)", "saver#save", "leaf"), (1, "donetrigger#(trigger)", "saver#save", "expanded"), (1, "lwc:panel#(file)", "saver#save", "leaf"),
    (1, "saver#fromflow", "saver#save", "expanded"), (1, "savertest#works", "saver#save", "leaf"), (1, "vf:pay#(file)", "saver#save", "leaf"),
    (2, "flow:nightly#(file)", "saver#fromflow", "expanded"), (3, "saver#save", "flow:nightly#(file)", "cyclic"), (2, "saver#save", "donetrigger#(trigger)", "cyclic"),
])
def code_callers(spark):
    return sample_graph(spark).callers("Saver#save").select("depth", "node", F.coalesce("parent", F.lit("")).alias("parent"), "state")


@query("node, parent, via, args, state", [
    ("invoicetrigger#(trigger)", "", "", "", "expanded"), ("invoicehandler#<init>", "invoicetrigger#(trigger)", "new", "", "leaf"), ("invoicehandler#run", "invoicetrigger#(trigger)", "typed", "", "expanded"),
    ("billing#<init>", "invoicehandler#run", "new", "", "leaf"), ("billing#charge", "invoicehandler#run", "typed", "acct: acctId, amount: 10.5", "leaf"), ("billing#audit", "invoicehandler#run", "static", "", "leaf"),
    ("invoicehandler#step", "invoicehandler#run", "this", "s: 'a, (b)'", "expanded"), ("billing#charge", "invoicehandler#step", "typed", "acct: s, amount: 1", "seen"),
])
def code_callees(spark):
    tree = sample_graph(spark).callees("InvoiceTrigger#(trigger)")
    return tree.select("node", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("via", F.lit("")).alias("via"), "args", "state")


@query("kind, label, detail", [
    ("async", "Job.execute", "queueable"), ("aura", "Saver.save", "auraenabled"), ("flow", "Nightly", "RecordAfterSave on Invoice__c"), ("flow", "Child", "screen or autolaunched (subflow of Nightly)"), ("invocable", "Saver.fromFlow", "invocablemethod"),
    ("trigger", "DoneTrigger", "on Done__e (after insert)"), ("trigger", "InvoiceTrigger", "on Invoice__c (after insert)"),
])
def code_entry_points(spark):
    return sample_graph(spark).entry_points().filter("not is_test").select("kind", "label", "detail")


@query("prefix, depth", [
    ("saver#save>flow:nightly#(file)", 2), ("saver#save>flow:nightly#(file)>saver#fromflow", 3), ("saver#save>flow:nightly#(file)>saver#fromflow>saver#save", 4), ("aura:box#(file)", 1), ("aura:box#(file)>saver#save", 2),
    ("lwc:panel#(file)", 1), ("lwc:panel#(file)>saver#save", 2), ("savertest#works", 1), ("savertest#works>saver#save", 2), ("vf:pay#(file)", 1), ("vf:pay#(file)>saver#save", 2),
    ("saver#save", 1), ("saver#save>donetrigger#(trigger)", 2), ("saver#save>donetrigger#(trigger)>saver#save", 3),
])
def code_entry_first(spark):
    return entry_first(sample_graph(spark).callers("Saver#save")).select("prefix", "depth")


@query("kind, label, class_name, method_name, namespace", [
    ("lwc", "panel", "Saver", "save", None), ("aura", "Box", "Saver", None, None), ("aura", "Box", "Saver", "save", None), ("flow", "Nightly", "Saver", None, None), ("flow", "Child", "Thing", None, "ns"),
    ("omniscript", "Pay", "Billing", "charge", None), ("vf", "Pay", "Billing", None, None), ("vf", "Pay", "Drawing", None, None), ("vf", "Pay", "Saver", None, None), ("vf", "Pay", "Billing", "save", None),
    ("vf", "Pay", "Drawing", "save", None), ("vf", "Pay", "Saver", "save", None), ("cmdt", "Map.One", "InvoiceHandler", None, None),
])
def code_metadata_refs(spark):
    return sample_graph(spark).refs.select("kind", "label", "class_name", "method_name", "namespace")


@query("namespace, class, refs, methods", [("ext", "gateway", 1, "ping"), ("ns", "thing", 1, "(class)")])
def code_externals(spark):
    return sample_graph(spark).externals()


@query("caller, flow, op", [("saver#save", "Nightly", "insert")])
def code_flow_launches(spark):
    return sample_graph(spark).flow_launches().select("caller", "flow", "op").distinct()


@query("caller, n", [("lonely#onlyhere", 1)])
def code_unresolved(spark):
    return sample_graph(spark).resolver.unresolved()


@query("id, split, accessor, ternary, made, chain, fit, sig", [
    (1, "Id|Map<Id, List<X>>", "Map<Id, List<X>>", "a|b", "Account", "b|c", 6, "run(String, Integer)"),
    (2, "A", None, "", "X.Y", "", 1, "run(Id)"),
    (3, "", "Case", "", None, "go", 0, "run()"),
])
def scalar_functions(spark):
    rows = [
        (1, "Id, Map<Id, List<X>>", "Map<Id, Map<Id, List<X>>>", "get", "(flag ? 'a' : 'b')", "((Account) x).y", "a.b().c(1)", ["'s'", "1"], ["String", "Integer"]),
        (2, "A", "Account", "get", "flag ? x : 'b'", "new X.Y(1)", "a.b(c(d)", ["x"], ["Id"]),
        (3, "", "List<Case>", "get", "", "x", "go()", [], []),
    ]
    df = spark.createDataFrame(rows, "id int, t string, type string, acc string, tern string, expr string, chain string, args array<string>, types array<string>")
    flat = lambda c: F.array_join(c, "|")
    return df.select(
        "id", flat(tx.split_outside(F.col("t"))).alias("split"), tx.accessor_type(F.col("type"), F.col("acc")).alias("accessor"), flat(tx.ternary_literals(F.col("tern"))).alias("ternary"),
        tx.made_or_cast(F.col("expr")).alias("made"), flat(tx.chain_segments(F.col("chain"))).alias("chain"), tx.argument_fit(F.col("args"), F.col("types")).alias("fit"), tx.signature(F.lit("run"), F.col("types")).alias("sig"),
    )


@pytest.mark.parametrize("name", list(CASES))
def test_sample_gives_these_rows(spark, name):
    f, columns, rows = CASES[name]
    assert Counter(map(tuple, f(spark).select(*columns).collect())) == Counter(rows)


def test_sites_entries_and_flow_trees(spark):
    graph = sample_graph(spark)
    assert {(r.caller, r.line, r.text) for r in graph.sites("Billing#audit").collect()} == {("invoicehandler#run", 6, "Billing.audit();")}
    assert {r["class"]: r.kinds for r in graph.class_entries().collect()} == {"Job": "async", "Saver": "aura, invocable", "DoneTrigger": "trigger", "InvoiceTrigger": "trigger"}
    down = [(r.depth, r.node, r.state) for r in graph.flow_trace("Nightly").collect()]
    assert sorted(down) == [(0, "flow:nightly#(file)", "expanded"), (1, "flow:child#(file)", "expanded"), (1, "saver#fromflow", "leaf"), (2, "ns.thing#(class)", "leaf")]
    up = {(r.depth, r.node) for r in graph.flow_trace("Child", "callers").collect()}
    assert up == {(0, "flow:child#(file)"), (1, "flow:nightly#(file)"), (2, "saver#save")}
    assert graph.unknown_subflows().count() == 0
    stats = trace_stats(graph.open_trace("Saver#save")).first()
    assert (stats["rows"], stats.cyclic, stats.capped) == (10, 2, False)


def test_objects_of_other_packages_are_external(spark):
    text = "public class Dml { void a(far__Thing__c t, Own_Thing__c o) { insert t; update o; far.Gate.ping(); } }"
    graph = CodeGraph(sample.frame(spark, {"/w/Dml.cls": text}))
    assert {(r.target_class, r.target_method) for r in graph.edges.filter("via = 'external'").collect()} == {("far.thing__c", "(object)"), ("far.gate", "ping")}
    tree = graph.callers("far").collect()
    assert [(r.depth, r.node) for r in tree] == [(0, "far"), (1, "dml#a")] and tree[1].n_sites == 2

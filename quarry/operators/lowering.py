"""From decoded instructions to the 32 operations of the intermediate form: one projection, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINOPS = {
    "+": "Add", "-": "Sub", "*": "Mul", "/": "Div", "%": "Rem", "&": "And", "|": "Or", "^": "Xor", "<<": "Shl", ">>": "Shr", "&^": "AndNot",
    "==": "Eq", "!=": "Neq", "<": "Lt", "<=": "Leq", ">": "Gt", ">=": "Geq",
}
UNOPS = {"-": "Neg", "!": "Not", "^": "BitNot"}
LOCKS = {"(*sync.Mutex).Lock": "Lock", "(*sync.RWMutex).Lock": "Lock", "(*sync.Mutex).Unlock": "Unlock", "(*sync.RWMutex).Unlock": "Unlock", "(*sync.RWMutex).RLock": "RLock", "(*sync.RWMutex).RUnlock": "RUnlock"}
#: Kinds whose operation follows from the kind alone and needs a register to write to.
DIRECT = {
    "Alloc": "Alloc", "FieldAddr": "FieldAddr", "Field": "Field", "IndexAddr": "IndexAddr", "Index": "Index", "Lookup": "Lookup", "Slice": "Slice", "Convert": "Convert", "ChangeInterface": "Convert",
    "SliceToArrayPointer": "Convert", "MultiConvert": "Convert", "ChangeType": "Assign", "Extract": "Extract", "Phi": "Phi", "MakeInterface": "MakeInterface", "MakeChan": "Make", "MakeMap": "Make", "MakeSlice": "Make",
    "MakeClosure": "MakeClosure", "Select": "Select", "TypeAssert": "TypeAssert", "BinOp": "BinOp", "UnOp": "UnOp",
}
EFFECTS = {"Store": "Store", "MapUpdate": "Store", "Return": "Return", "Jump": "Jump", "If": "Branch", "Panic": "Panic", "Send": "Send", "Call": "Call", "Go": "Go", "Defer": "Defer", "Range": "Havoc", "Next": "Havoc"}
DROPPED = ("DebugRef", "RunDefers")


def _map(d: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def lowered(wire: DataFrame, value: DataFrame) -> DataFrame:
    """instr rows. A kind that isn't modelled, or lacks what it needs, is Havoc; two kinds without meaning are dropped. Plain calls of lock
    methods and of close become Lock and CloseChan; calls by go and defer don't."""
    kind, tok = F.col("kind"), F.col("token")
    refs = value.where("kind = 'Function'").select("func", F.col("vid").alias("_v"), F.col("ref_name").alias("_target"))
    w = wire.where(~kind.isin(*DROPPED)).withColumn("_v", F.when(kind == "MakeClosure", F.try_element_at("operands", F.lit(1)))).join(refs, ["func", "_v"], "left")
    lock = F.when((kind == "Call") & (F.col("callee_kind") == "Static"), _map(LOCKS, F.col("callee")))
    close = (kind == "Call") & (F.col("callee_kind") == "Builtin") & (F.col("callee") == "close")
    unop = F.when(tok == "*", "Load").when(tok == "<-", "Recv").when(_map(UNOPS, tok).isNotNull(), "UnOp").otherwise("Havoc")
    needs = F.when(kind == "BinOp", _map(BINOPS, tok).isNotNull()).when(kind == "MakeClosure", F.col("_target").isNotNull()).when(kind == "Select", F.col("blocking").isNotNull()).when(kind == "TypeAssert", F.col("comma_ok").isNotNull()).otherwise(F.lit(True))
    direct = F.when((F.col("register") == 0) | ~F.coalesce(needs, F.lit(False)), "Havoc").when(kind == "UnOp", unop).otherwise(_map(DIRECT, kind))
    called = F.when(kind.isin("Call", "Go", "Defer") & F.col("callee_kind").isNull(), "Havoc")
    op = F.when(_map(DIRECT, kind).isNotNull(), direct).when(called.isNotNull(), called).when(lock.isNotNull(), "Lock").when(close, "CloseChan").otherwise(F.coalesce(_map(EFFECTS, kind), F.lit("Havoc")))
    a = lambda n: F.coalesce(F.try_element_at("operands", F.lit(n)), F.lit(0))
    opt = lambda n: F.nullif(a(n), F.lit(0))
    rest = F.expr("slice(operands, 2, greatest(size(operands) - 1, 0))")
    args = F.when(kind.isin("Call", "Go", "Defer") & (F.col("callee_kind") != "Invoke"), rest).when(kind == "MakeClosure", rest).otherwise(F.col("operands"))
    is_ = lambda *k: F.col("op").isin(*k)
    two = ("Store", "IndexAddr", "Index", "Lookup", "BinOp", "Send")
    one = (*two, "Load", "Recv", "UnOp", "FieldAddr", "Field", "Slice", "Convert", "Assign", "Extract", "MakeInterface", "Branch", "Panic", "TypeAssert")
    sub = F.when(is_("BinOp"), _map(BINOPS, tok)).when(is_("UnOp"), _map(UNOPS, tok)).when(is_("Make"), F.substring("kind", 5, 9)).when(is_("Lock"), _map(LOCKS, F.col("callee")))
    call = is_("Call", "Go", "Defer")
    dst = F.when(F.col("register") != 0, F.when(is_("Store", "Return", "Jump", "Branch", "Panic", "Send", "Go", "Defer", "Lock", "CloseChan"), None).otherwise(F.col("register")))
    a0 = F.when(is_(*one), a(1)).when(is_("Lock", "CloseChan"), a(2)).when(call & (F.col("callee_kind") == "Dynamic"), a(1))
    return w.withColumn("op", op).withColumn("args", args).select(
        "func", "b", "i", "op", dst.alias("dst"), "type_id", a0.alias("a0"),
        F.when(kind == "MapUpdate", a(3)).when(is_(*two), a(2)).when(is_("Slice"), opt(2)).alias("a1"), F.when(is_("Slice"), opt(3)).alias("a2"), F.when(is_("Slice"), opt(4)).alias("a3"),
        F.when(kind == "MakeChan", F.slice("operands", 1, 1)).when(kind == "MakeSlice", F.slice("operands", 1, 2)).otherwise(F.col("args")).alias("operands"),
        F.when(is_("FieldAddr", "Field"), F.coalesce("field", F.lit(0))).when(is_("Extract"), F.coalesce("idx", F.lit(0))).when(is_("Alloc"), F.col("heap").cast("int")).alias("field"), sub.alias("sub"),
        F.when(call, F.col("callee_kind")).alias("callee_kind"), F.when(call, F.col("callee")).when(is_("MakeClosure"), F.col("_target")).alias("callee"), F.when(call | is_("TypeAssert"), F.col("iface")).alias("iface"),
        F.when(call, F.col("method")).alias("method"), F.when(call, F.col("sig")).alias("sig"), F.when(is_("Select"), F.col("blocking")).alias("blocking"),
        F.when(is_("Recv", "Lookup", "TypeAssert"), F.coalesce("comma_ok", F.lit(False))).alias("comma_ok"), "file", "line", "col",
    )


def diagnostics(wire: DataFrame, instr: DataFrame) -> DataFrame:
    """func, kind: what was turned into Havoc though it isn't one by nature."""
    h = instr.where("op = 'Havoc'").select("func", "b", "i")
    return wire.join(h, ["func", "b", "i"]).where("kind not in ('Range', 'Next')").select("func", "kind")


def lines(instr: DataFrame, arms: DataFrame) -> DataFrame:
    """func, b, i, line: an instruction as text."""
    v = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    vs = F.array_join(F.transform("operands", lambda x: F.concat(F.lit("v"), x.cast("string"))), " ")
    arm = arms.groupBy("func", "b", "i").agg(F.sort_array(F.collect_list(F.struct("arm", F.when(F.col("send").isNotNull(), F.concat(F.lit("send "), v("chan"), F.lit(" <- "), v("send"))).otherwise(F.concat(F.lit("recv "), v("chan"))).alias("t")))).alias("_arms"))
    df = instr.join(arm, ["func", "b", "i"], "left")
    callee = F.when(F.col("callee_kind") == "Static", F.concat(F.lit("call "), "callee")).when(F.col("callee_kind") == "Builtin", F.concat(F.lit("call-builtin "), "callee"))
    callee = callee.when(F.col("callee_kind") == "Invoke", F.concat(F.lit("call-invoke t"), F.col("iface").cast("string"), F.lit("."), "method")).otherwise(F.concat(F.lit("call-dyn "), v("a0")))
    call = F.concat(callee, F.lit("("), vs, F.lit(")"))
    cat = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    ok = cat(" ok=", F.col("comma_ok").cast("string"))
    blank = lambda c: F.coalesce(v(c), F.lit(""))
    forms = {
        "Assign": cat("assign ", v("a0")), "Alloc": cat("alloc heap=", F.when(F.col("field") == 1, "true").otherwise("false")), "Load": cat("load ", v("a0")), "Store": cat("store ", v("a0"), " <- ", v("a1")),
        "FieldAddr": cat("field-addr ", v("a0"), " #", F.col("field").cast("string")), "Field": cat("field ", v("a0"), " #", F.col("field").cast("string")), "IndexAddr": cat("index-addr ", v("a0"), " ", v("a1")),
        "Index": cat("index ", v("a0"), " ", v("a1")), "Lookup": cat("lookup ", v("a0"), " ", v("a1"), ok), "Slice": cat("slice ", v("a0"), " [", blank("a1"), ":", blank("a2"), ":", blank("a3"), "]"),
        "BinOp": cat("binop ", F.col("sub"), " ", v("a0"), " ", v("a1")), "UnOp": cat("unop ", F.col("sub"), " ", v("a0")), "Convert": cat("convert ", v("a0")), "Extract": cat("extract ", v("a0"), " #", F.col("field").cast("string")),
        "Phi": cat("phi ", vs), "Call": call, "MakeClosure": cat("make-closure ", F.col("callee"), " [", vs, "]"), "MakeInterface": cat("make-interface ", v("a0")), "Make": cat("make ", F.col("sub"), " ", vs),
        "Send": cat("send ", v("a0"), " <- ", v("a1")), "Recv": cat("recv ", v("a0"), ok), "CloseChan": cat("close ", v("a0")),
        "Select": cat("select blocking=", F.col("blocking").cast("string"), " [", F.array_join(F.transform("_arms", lambda x: x["t"]), ", "), "]"), "Go": cat("go ", call), "Defer": cat("defer ", call), "Return": cat("return ", vs), "Jump": F.lit("jump"),
        "Branch": cat("branch ", v("a0")), "Panic": cat("panic ", v("a0")), "TypeAssert": cat("type-assert ", v("a0"), " t", F.col("iface").cast("string"), ok), "Lock": cat(F.lower("sub"), " ", v("a0")), "Havoc": F.lit("havoc"),
    }
    text = F.coalesce(*[F.when(F.col("op") == k, t) for k, t in forms.items()])
    return df.select("func", "b", "i", F.when(F.col("dst").isNotNull(), F.concat(v("dst"), F.lit(" = "), text)).otherwise(text).alias("line"))


def dumped(func: DataFrame, param: DataFrame, value: DataFrame, edges: DataFrame, block: DataFrame, instr: DataFrame, arms: DataFrame) -> DataFrame:
    """func, text: a function's body as text: parameters, constants and other outside values, blocks with successors, instructions."""
    ordered = lambda df, keys, c: df.groupBy("func").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*keys, c))), lambda x: x[c]), "")).toDF("func", c)
    num = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    ps = param.groupBy("func").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", num("vid").alias("t")))), lambda x: x["t"]), ", ").alias("ps"))
    const = F.when(F.col("const_kind") == "Int", F.concat(F.lit("Int("), F.col("const_int").cast("string"), F.lit(")"))).when(F.col("const_kind") == "Bool", F.concat(F.lit("Bool("), F.col("const_bool").cast("string"), F.lit(")"))).otherwise(F.col("const_kind"))
    what = F.when(F.col("kind") == "Const", F.concat(F.lit("const "), const)).when(F.col("kind") == "Global", F.concat(F.lit("global "), "ref_name")).when(F.col("kind") == "Function", F.concat(F.lit("func "), "ref_name")).when(F.col("kind") == "Builtin", F.concat(F.lit("builtin "), "ref_name"))
    aux = ordered(value.select("func", "vid", F.concat(F.lit("  aux "), num("vid"), F.lit(" = "), what, F.lit("\n")).alias("aux")).where("aux is not null"), ["vid"], "aux")
    succs = edges.groupBy("func", F.col("src").alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("succ_pos", "dst"))), lambda x: x["dst"].cast("string")), ", ").alias("ss"))
    heads = block.join(succs, ["func", "b"], "left").select("func", "b", F.lit(-1).alias("i"), F.concat(F.lit("  b"), F.col("b").cast("string"), F.lit(" -> ["), F.coalesce("ss", F.lit("")), F.lit("]\n")).alias("body"))
    body = heads.unionByName(lines(instr, arms).select("func", "b", "i", F.concat(F.lit("    "), "line", F.lit("\n")).alias("body")))
    df = func.join(ps, "func", "left").join(aux, "func", "left").join(ordered(body, ["b", "i"], "body"), "func", "left")
    full = F.concat(F.lit("func "), "func", F.lit(" ("), F.coalesce("ps", F.lit("")), F.lit(")\n"), F.coalesce("aux", F.lit("")), F.coalesce("body", F.lit("")))
    return df.select("func", F.when(F.col("has_body"), full).otherwise(F.concat(F.lit("func "), "func", F.lit(" <external>\n"))).alias("text"))

"""Status, settings, agreement and admission on small tables."""

from pyspark.sql import functions as F

from treeloom.operators import admission, signatures, status


def rows(df):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_settings_take_the_first_layer_that_says_something(spark):
    layers = spark.createDataFrame(
        [(1, "yes", "off", False, " a ,,b ", ["c"], "NEVER", 7, " 50 "), (2, "maybe", "on", False, " , ", ["c"], "soon", None, "x"), (3, None, None, None, None, None, None, None, None), (4, None, None, True, None, [], None, 0, None)],
        "id long, no_tofu_flag string, no_tofu_env string, no_tofu_conf boolean, auth_keys_flag string, auth_keys_conf array<string>, ttl_flag string, ttl_conf long, debounce_ms_env string")
    told = status.settings(layers)
    assert rows(told.select("id", "no_tofu", "auth_keys", "client_key", "tofu", "ttl_days", "debounce_ms", "include", "listen")) == {
        (1, True, ("a", "b"), "a", False, 0, 50, ("**",), None), (2, True, ("c",), None, False, 90, 1000, ("**",), None),
        (3, False, (), None, True, 90, 1000, ("**",), None), (4, True, (), None, False, 0, 1000, ("**",), None)}
    assert status.settings(layers.limit(0)).count() == 0


def test_states_and_their_order(spark):
    vaults = spark.createDataFrame(
        [("d", "a", True, False, "m"), ("d", "b", True, True, "m"), ("d", "c", False, True, "m"), ("e", "a", True, None, None), ("f", "a", None, True, "m"), ("f", "b", False, None, None), ("g", "a", True, None, "m"), ("g", "b", True, None, None)],
        "day string, vault_id string, enabled boolean, failed boolean, main_oid string")
    states = status.sync_states(vaults)
    assert [r.state for r in states.orderBy("day", "vault_id").collect()] == ["active", "error", "disabled", "idle", "disabled", "disabled", "active", "idle"]
    assert rows(status.rolled_up(states, ["day"])) == {("d", 3, 1, 1, "error"), ("e", 1, 0, 0, "idle"), ("f", 2, 0, 0, "disabled"), ("g", 2, 1, 0, "active")}


def test_status_has_a_row_for_a_vault_of_which_nothing_is_known(spark):
    frame = spark.createDataFrame
    told = status.vault_status(
        frame([("v",), ("w",)], "vault_id string"), frame([("v", "x", True), ("v", "y", False), ("u", "z", True)], "vault_id string, oid string, is_primitive boolean"), frame([("v", "0123456789abcdef")], "vault_id string, main_oid string"),
        frame([("v", "x", 2), ("v", "a", 1)], "vault_id string, oid string, k int"), frame([("v", "n", "at", 5), ("v", "n", "never", None), ("v", "o", "at", 5)], "vault_id string, node_id string, kind string, at long"),
        frame([("v", "p2"), ("v", "p1"), ("v", "p2"), ("w", None)], "vault_id string, peer string"), F.lit(10))
    assert rows(told) == {("v", "0123456789abcdef", "0123456789ab", 1, ("a", "x"), 2, 1, False, ("p1", "p2")), ("w", None, None, 0, (), 0, 0, True, ())}


def test_agreement_needs_the_same_set_and_the_same_main(spark):
    known = spark.createDataFrame([("v", 1, "a"), ("v", 2, "a"), ("w", 1, "a"), ("w", 2, "b"), ("x", 1, "a"), ("x", 2, "a")], "vault_id string, replica int, oid string")
    mains = spark.createDataFrame([("v", 1, "m"), ("v", 2, "m"), ("w", 1, "m"), ("w", 2, "m"), ("x", 1, "m"), ("x", 2, "n"), ("y", 1, "m"), ("y", 2, "m")], "vault_id string, replica int, main_oid string")
    assert rows(status.agreement(known, mains)) == {("v", 2, 1, 1, True), ("w", 2, 1, 2, False), ("x", 2, 2, 1, False), ("y", 2, 1, 1, True)}


def test_batches_are_admitted_after_folds_and_signatures(spark):
    key, good = signatures.signature_of(bytes(range(32)), b"m")
    forged = bytes([good[0] ^ 1]) + good[1:]
    schema = "vault_id string, batch_id int, oid string, is_primitive boolean, counter long, node_key binary, message binary, signature binary"
    sent = spark.createDataFrame([
        ("v", 1, "a", True, 4, key, b"m", good), ("v", 1, "b", True, 9, key, b"m", forged), ("v", 2, "a", True, 4, key, b"m", good), ("v", 2, "f", False, None, None, None, None),
        ("v", 3, "c", True, 20, key, b"m", good), ("v", 3, "bad", False, None, None, None, None), ("v", 4, "b", True, 9, key, b"m", good), ("v", 4, "known", True, 7, None, None, None), ("v", 5, "d", True, 30, None, None, None),
        ("w", 3, "bad", False, None, None, None, None), ("w", 3, "a", True, 5, key, b"m", good)], schema)
    wrong = spark.createDataFrame([("v", "bad")], "vault_id string, oid string")
    known = spark.createDataFrame([("v", "known")], "vault_id string, oid string")
    told = admission.judged(sent, wrong, known)
    assert told.count() == sent.count() and told.columns == [*sent.columns, "fold_ok", "sig_ok"]
    assert rows(admission.admitted(told, known)) == {("v", 1, "a"), ("v", 4, "b"), ("w", 3, "a")}
    counters = spark.createDataFrame([("v", 8), ("u", 3)], "vault_id string, observed long")
    assert rows(admission.observed(told, counters)) == {("v", 9), ("w", 5), ("u", 3)}
    assert admission.admitted(admission.judged(sent.limit(0), wrong, known), known).count() == 0

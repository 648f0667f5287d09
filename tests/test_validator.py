"""The validator of the index: every code from a row that asks for it, and none from a sound index."""

from assayloom import catalog
from assayloom.operators import validator

PROFILE = "profile_id string, cas_no string, cas_no_raw string, parent_profile_id string, is_parent boolean, active boolean, default_recommended boolean, selectable boolean, canonical_name string, source_version string"
RELATION = "relation_id string, source string, target string, active boolean, review_status string"
RULE = "rule_id string, source string, target string, active boolean, final_decision string, review_status string, require_user_confirmation boolean, auto_confirmed boolean, default_selected boolean, allow_multiple boolean, target_cas string, target_name string"
GOOD = ("P1", "64-17-5", "64-17-5", None, True, True, True, True, "Ethyl alcohol", validator.MASTER_VERSION)
CHILD = ("P2", "67-64-1", "67-64-1", "P1", False, True, False, True, "Acetone", validator.MASTER_VERSION)


def found(spark, profiles, relations, rules, **more):
    df = validator.issues(spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(relations, RELATION), spark.createDataFrame(rules, RULE), **more)
    return sorted(((r.code, r.entity_id) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def test_sound_index_has_no_issues(spark):
    relations, rules = [("R1", "P1", "P2", True, "APPROVED")], [("U1", "P1", "P2", True, "승인", "APPROVED", True, False, True, True, "67-64-1", "ACE-TONE")]
    assert found(spark, [GOOD, CHILD], relations, rules, expected=2, source_rows=2, decisions=(1, 1)) == []


def test_each_code(spark):
    profiles = [
        GOOD, CHILD, CHILD, (None, *GOOD[1:4], False, *GOOD[5:]), ("P3", "64175", "64175", "P9", True, False, True, False, "x", "other"), ("P4", "1-2 등", "1-2 등", None, False, True, False, True, "y", "other"),
        ("P5", "64-17-5", "64-17-5", None, True, True, False, True, "z", "other"),
    ]
    relations = [("R1", "P1", "P2", True, "APPROVED"), ("R1", "P1", "P2", False, "APPROVED"), ("R2", "P3", None, True, "REVIEW_REQUIRED"), ("R3", "P1", "P1", False, "APPROVED")]
    rules = [
        ("U1", "P3", "P8", True, "보류", "REVIEW_REQUIRED", True, True, True, False, "", ""), ("U2", "P1", "P2", False, "제외", "APPROVED", False, True, None, False, "64-17-5", "Ethanol"), ("U2", "P1", "P2", False, "승인", "APPROVED", False, False, False, False, "", "acetone"),
    ]
    path = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    texts = spark.createDataFrame([("a", f"see {validator.OLD_PATHS[0]}"), ("b", "nothing")], "path string, text string")
    assert found(spark, profiles, relations, rules, expected=9, source_rows=8, decisions=(3, 2), referenced=path("a", "gone"), present=path("a"), texts=texts) == sorted([
        ("DUPLICATE_PROFILE_ID", "P2"), ("MISSING_PROFILE_ID", None), ("NONSTANDARD_RUNTIME_CAS", "P3"), ("NONSTANDARD_RUNTIME_CAS", "P4"), ("CAS_RAW_USED_AS_RUNTIME_KEY", "P4"), ("CAS_RAW_NOT_SEPARATED", "P4"),
        ("MISSING_PARENT_PROFILE", "P3"), ("INACTIVE_PARENT_PROFILE", "P3"), ("DEFAULT_RECOMMENDED_NOT_SELECTABLE", "P3"), ("DUPLICATE_RELATION_ID", "R1"), ("ACTIVE_RELATION_PROFILE_MISSING", "R2"),
        ("ACTIVE_RELATION_PROFILE_INACTIVE", "R2"), ("SELF_RELATION", "R3"), ("REVIEW_RELATION_ACTIVE", "R2"), ("DUPLICATE_RULE_ID", "U2"), ("EXCLUDED_RULE_EMITTED", "U2"), ("REVIEW_RULE_ACTIVE", "U1"),
        ("HELD_RULE_ACTIVE", "U1"), ("USER_CONFIRMATION_BYPASSED", "U1"), ("ACTIVE_RULE_PROFILE_MISSING", "U1"), ("ACTIVE_RULE_PROFILE_INACTIVE", "U1"), ("DEFAULT_SELECTED_SINGLE_POLICY", "U1"),
        ("TARGET_CAS_DIRECTION_MISMATCH", "U2"), ("TARGET_NAME_NORMALIZED", "U2"), ("MULTIPLE_PARENT_PROFILES", "64-17-5"), ("SOURCE_ROW_COUNT_MISMATCH", None), ("MASTER_PROFILE_COUNT_MISMATCH", None),
        ("REVIEW_DECISION_COUNT_MISMATCH", None), ("REFERENCE_PATH_MISSING", "gone"), ("OLD_PATH_REFERENCE", validator.OLD_PATHS[0]),
    ], key=lambda x: (x[0], x[1] or ""))


def test_query_meets_all_codes(spark):
    catalog.load_all()
    assert len({r.code for r in catalog.QUERIES["etl06_validator"](spark, "/root/testdata/sf0.01").select("code").distinct().collect()}) == 29

"""Fixed schemas of the domain tables (S-02); nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "bool": T.BooleanType(), "date": T.DateType(), "ts": T.TimestampNTZType(), "tz": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split(":") for f in spec.split())])


SUBSTITUTION = _struct(
    "word:string position:int position_in_word:int word_position:int expected:string actual:string type:string"
)
WORD_ANALYSIS = T.StructType(
    _struct(
        "word:string actual:string similarity:double is_correct:bool error:string position:int"
        " phonetic_match:bool feedback:string"
    ).fields
    + [T.StructField("substitutions", T.ArrayType(SUBSTITUTION))]
)

SCHEMAS = {
    "children": _struct(
        "child_id:long caregiver_id:int name:string age:int therapy_goals:string notes:string created_at:date"
    ),
    "caregivers": _struct("caregiver_id:int username:string email:string is_active:bool"),
    "child_category": _struct("child_id:long category_id:int"),
    "activity_categories": _struct("category_id:int name:string description:string type:string difficulty_level:string"),
    "activity_items": _struct(
        "item_id:long name:string category_id:int difficulty_level:string image_url:string audio_url:string"
    ),
    "therapy_sessions": _struct(
        "session_id:long child_id:long caregiver_id:int category_id:int start_time:ts end_time:ts"
        " current_level:string is_completed:bool"
    ),
    "session_activities": T.StructType(
        _struct(
            "activity_id:long session_id:long item_id:long attempt_number:int is_correct:bool response_type:string"
            " response_text:string feedback:string pronunciation_score:double response_time_seconds:double"
            " error_type:string repetition_count:int stammering_detected:bool correct_word_count:int"
            " total_word_count:int created_at:ts"
        ).fields
        + [
            T.StructField("substitutions", T.ArrayType(SUBSTITUTION)),
            T.StructField("word_analysis", T.ArrayType(WORD_ANALYSIS)),
        ]
    ),
    "caregiver_feedback": _struct(
        "feedback_id:long session_id:long child_id:long caregiver_id:int rating:int comments:string"
        " progress_achievements:string areas_for_improvement:string behavioral_observations:string"
        " created_at:ts feedback_type:string"
    ),
    "child_performance": _struct(
        "child_id:long category_id:int overall_score:double verbal_attempts:long verbal_success:long"
        " selection_attempts:long selection_success:long last_updated:ts"
    ),
    "learning_paths": _struct(
        "child_id:long category_id:int target_score:double current_priority:int status:string"
    ),
    "gaze_tracking": _struct(
        "session_id:long child_id:long session_duration:long on_screen_ms:long off_screen_ms:long start_ms:long"
        " end_ms:long on_screen_percentage:double total_points:int"
    ),
    "messages": _struct(
        "connection_id:string type:string session_id:string item_id:string response:string score:double"
        " command:string ts:tz"
    ),
}

#: The parquet tables that the domain is derived from.
SOURCES = {
    "nation": _struct("n_nationkey:int n_name:string n_regionkey:int"),
    "customer": _struct("c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"),
    "part": _struct("p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double"),
    "orders": _struct(
        "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ts o_orderpriority:string"
    ),
    "lineitem": _struct(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double"
        " l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:ts"
    ),
    "events": _struct("event_id:long ts:ts user_id:long event_type:string value:double props:string"),
    "conversations": _struct("conv_id:long turn:long role:string text:string"),
}

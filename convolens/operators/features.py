"""Per-conversation feature operators (T, M, R, V, H, X, C) and their fold.

Each feature is a small spec: optional *anchors* (aggregates of a segment that
its other aggregates refer to, e.g. the position of the first hand-off
invitation), *aggregates* with the way they *merge*, and *outputs* (column
expressions over the aggregated row that may read columns produced by features
earlier in the chain).

The fold turns a list of specs into one scan of the messages:

* without anchors: one ``groupBy(key).agg(...)`` with partial aggregation;
* with anchors: messages are dealt by ``(key, segment)`` once
  (``operators/segments.py``); the anchors are window aggregates over that
  partitioning and the aggregates follow on it without another exchange.  The
  states of a conversation's segments, if it has several, are then merged in
  order.

A segment is the whole conversation unless that holds a large share of all
messages; then it is a bounded stretch of it.  Nothing collects a conversation
into one row.  Order-dependent features use the unique ordering key of
``order_key`` with ``max_by`` / ``min_by`` instead of a dense message ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.functions import patterns as P
from convolens.functions.text import (
    contains_any,
    lead_name,
    literal_regex,
    rlike_any,
    strip_accents,
    strip_accents_py,
    truncate_text,
)
from convolens.functions.timefmt import hours_minutes, iso_in_zone, seconds_between, ts_text19
from convolens.operators.segments import MERGES, SEGMENT, Cuts, Merge, cuts_of, merge_states
from convolens.operators.transcript import digest_of, digest_parts
from convolens.session import AS_OF_DEFAULT

ORD = "__ord"


class Msg:
    """Column expressions over one message row (the processors' vocabulary)."""

    def __init__(self, key: str = "cleaned_phone"):
        self.key = key
        self.t = F.col("creation_time")
        self.ord = F.col(ORD)
        self.sender = F.col("msg_from")
        self.sender_l = F.lower(F.col("msg_from"))
        self.raw_text = F.col("message")
        self.text = F.coalesce(F.col("message"), F.lit(""))
        # T and M compare the lower-cased sender; R, V, H, X the exact one.
        self.is_user_l = self.sender_l == "user"
        self.is_kuna_l = self.sender_l.isin("bot", "operator")
        self.is_bot = F.coalesce(self.sender == "bot", F.lit(False))
        self.is_user = F.coalesce(self.sender == "user", F.lit(False))


class Agg:
    """Accessor for aggregated columns of one spec inside the fold."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __call__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")


@dataclass
class Feature:
    """Base class of a feature spec (the processor extension surface, E1)."""

    params: dict = field(default_factory=dict)

    name: ClassVar[str] = "Feature"
    alias: ClassVar[str] = "feature"
    columns: ClassVar[list[tuple[str, T.DataType]]] = []
    known_params: ClassVar[frozenset[str]] = frozenset()

    def __post_init__(self):
        unknown = set(self.params) - set(self.known_params)
        if unknown:
            raise ValueError(f"Unknown parameter(s) {sorted(unknown)} for {self.name}")

    @property
    def prefix(self) -> str:
        return f"__{self.alias}_"

    def p(self, key: str, default=None):
        return self.params.get(key, default)

    # per segment ---------------------------------------------------------------
    def anchors(self, m: Msg) -> dict[str, Column]:
        return {}

    def aggregates(self, m: Msg) -> dict[str, Column]:
        return {}

    def merges(self) -> dict[str, str | Merge]:
        """How each aggregate of two neighbouring segments becomes one: a name
        in :data:`MERGES` or a function ``(left, right, name) -> Column``.
        Without one a conversation is never cut (and cannot be kept as a state)."""
        return {}

    # final projection ----------------------------------------------------------
    def outputs(self, a: Agg, prior: dict[str, Column], as_of: Column) -> dict[str, Column]:
        raise NotImplementedError

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True) for n, t in self.columns])


def _anchor(f: Feature, name: str) -> Column:
    return F.col(f"{f.prefix}{name}")


# --------------------------------------------------------------------------- T
class Temporal(Feature):
    """Last message / last user message times and ages."""

    name = "TemporalProcessor"
    alias = "temporal"
    columns = [
        ("HOURS_MINUTES_SINCE_LAST_USER_MESSAGE", T.StringType()),
        ("HOURS_MINUTES_SINCE_LAST_MESSAGE", T.StringType()),
        ("IS_WITHIN_REACTIVATION_WINDOW", T.BooleanType()),
        ("IS_RECOVERY_PHASE_ELIGIBLE", T.BooleanType()),
        ("LAST_USER_MESSAGE_TIMESTAMP_TZ", T.StringType()),
        ("LAST_MESSAGE_TIMESTAMP_TZ", T.StringType()),
        ("NO_USER_MESSAGES_EXIST", T.BooleanType()),
    ]
    known_params = frozenset({"timezone", "skip_detailed_temporal"})

    def aggregates(self, m):
        if self.p("skip_detailed_temporal", False):
            return {}
        return {
            f"{self.prefix}last": F.max(m.t),
            f"{self.prefix}last_user": F.max(F.when(m.is_user_l, m.t)),
        }

    def merges(self):
        return {n: "max" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        if self.p("skip_detailed_temporal", False):
            return {
                "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE": F.lit(None).cast("string"),
                "HOURS_MINUTES_SINCE_LAST_MESSAGE": F.lit(None).cast("string"),
                "IS_WITHIN_REACTIVATION_WINDOW": F.lit(False),
                "IS_RECOVERY_PHASE_ELIGIBLE": F.lit(False),
                "LAST_USER_MESSAGE_TIMESTAMP_TZ": F.lit(None).cast("string"),
                "LAST_MESSAGE_TIMESTAMP_TZ": F.lit(None).cast("string"),
                "NO_USER_MESSAGES_EXIST": F.lit(True),
            }
        tz = self.p("timezone", "America/Mexico_City")
        last, last_user = a("last"), a("last_user")
        sec, sec_user = seconds_between(as_of, last), seconds_between(as_of, last_user)
        user_hours = sec_user / F.lit(3600.0)
        return {
            "HOURS_MINUTES_SINCE_LAST_USER_MESSAGE": hours_minutes(sec_user),
            "HOURS_MINUTES_SINCE_LAST_MESSAGE": hours_minutes(sec),
            "IS_WITHIN_REACTIVATION_WINDOW": F.coalesce(user_hours < 24, F.lit(False)),
            "IS_RECOVERY_PHASE_ELIGIBLE": F.coalesce(user_hours >= 24, F.lit(False)),
            "LAST_USER_MESSAGE_TIMESTAMP_TZ": iso_in_zone(last_user, tz),
            "LAST_MESSAGE_TIMESTAMP_TZ": iso_in_zone(last, tz),
            "NO_USER_MESSAGES_EXIST": last_user.isNull(),
        }


# --------------------------------------------------------------------------- M
class Metadata(Feature):
    """M1-M4: last sender, last user / agent texts (whole unless
    ``max_message_length`` is given), raw time of the last row."""

    name = "MessageMetadataProcessor"
    alias = "metadata"
    columns = [
        ("last_message_sender", T.StringType()),
        ("last_user_message_text", T.StringType()),
        ("last_kuna_message_text", T.StringType()),
        ("last_message_ts", T.StringType()),
    ]
    known_params = frozenset({"max_message_length"})

    def aggregates(self, m):
        return {
            f"{self.prefix}sender": F.max_by(F.struct(m.sender_l.alias("v")), m.ord),
            f"{self.prefix}user_text": F.max_by(F.struct(m.raw_text.alias("v")), F.when(m.is_user_l, m.ord)),
            f"{self.prefix}kuna_text": F.max_by(F.struct(m.raw_text.alias("v")), F.when(m.is_kuna_l, m.ord)),
            f"{self.prefix}ts": F.max_by(F.struct(m.t.alias("v")), m.ord),
        }

    def merges(self):
        return {n: "last" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        n = self.p("max_message_length")
        cut = (lambda c: truncate_text(c, int(n))) if n is not None else (lambda c: c)
        return {
            "last_message_sender": F.when(a("sender")["v"] == "user", F.lit("user")).otherwise(F.lit("kuna")),
            "last_user_message_text": cut(F.coalesce(a("user_text")["v"], F.lit("N/A"))),
            "last_kuna_message_text": cut(F.coalesce(a("kuna_text")["v"], F.lit("N/A"))),
            "last_message_ts": ts_text19(a("ts")["v"]),
        }


# --------------------------------------------------------------------------- R
class Template(Feature):
    """Recovery template on the last bot row; trailing template run."""

    name = "TemplateDetectionProcessor"
    alias = "template"
    columns = [
        ("recovery_template_detected", T.BooleanType()),
        ("consecutive_recovery_templates_count", T.IntegerType()),
    ]
    known_params = frozenset({"template_type", "skip_recovery_template", "skip_consecutive_count"})

    def _active(self) -> bool:
        return (not self.p("skip_recovery_template", False)) and str(
            self.p("template_type", "all")
        ).lower() in ("all", "recovery")

    def _count(self) -> bool:
        return self._active() and not self.p("skip_consecutive_count", False)

    @staticmethod
    def _hit(m: Msg) -> Column:
        return contains_any(F.lower(m.text), P.RECOVERY_TEMPLATE_PHRASES)

    def anchors(self, m):
        if not self._count():
            return {}
        # position of the last row that ends a template run (anything but a bot template)
        return {f"{self.prefix}break": F.max(F.when(~(m.is_bot & self._hit(m)), m.ord))}

    def aggregates(self, m):
        if not self._active():
            return {}
        out = {f"{self.prefix}last_bot_hit": F.max_by(self._hit(m), F.when(m.is_bot, m.ord))}
        if self._count():
            brk = _anchor(self, "break")
            out[f"{self.prefix}run"] = F.count(F.when(brk.isNull() | (m.ord > brk), F.lit(1)))
            out[f"{self.prefix}broken"] = F.max(brk.isNotNull())
        return out

    def merges(self):
        run, broken = f"{self.prefix}run", f"{self.prefix}broken"
        goes_on = lambda left, right, _: F.when(right(broken), right(run)).otherwise(left(run) + right(run))
        every = {f"{self.prefix}last_bot_hit": "last", run: goes_on, broken: "any"}
        return {n: every[n] for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        detected = F.coalesce(a("last_bot_hit"), F.lit(False)) if self._active() else F.lit(False)
        run = a("run").cast("int") if self._count() else F.lit(0)
        return {"recovery_template_detected": detected, "consecutive_recovery_templates_count": run}


# --------------------------------------------------------------------------- V
class Validation(Feature):
    """V1: any bot row carries a pre-validation question."""

    name = "ValidationProcessor"
    alias = "validation"
    columns = [("pre_validacion_detected", T.BooleanType())]
    known_params = frozenset({"skip_validacion_detection"})

    def aggregates(self, m):
        if self.p("skip_validacion_detection", False):
            return {}
        hit = contains_any(strip_accents(F.lower(m.text)), P.PRE_VALIDATION_PHRASES)
        return {f"{self.prefix}hit": F.bool_or(m.is_bot & hit)}

    def merges(self):
        return {n: "any" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        if self.p("skip_validacion_detection", False):
            return {"pre_validacion_detected": F.lit(False)}
        return {"pre_validacion_detected": F.coalesce(a("hit"), F.lit(False))}


# --------------------------------------------------------------------------- H
class Handoff(Feature):
    """H1-H4: first invitation, classified first user reply after it, completion."""

    name = "HandoffProcessor"
    alias = "handoff"
    columns = [
        ("handoff_invitation_detected", T.BooleanType()),
        ("handoff_response", T.StringType()),
        ("handoff_finalized", T.BooleanType()),
    ]
    known_params = frozenset({"skip_handoff_invitation", "skip_handoff_started", "skip_handoff_finalized", "strict"})

    def _invite(self) -> bool:
        return not self.p("skip_handoff_invitation", False)

    def anchors(self, m):
        if not self._invite():
            return {}
        hit = rlike_any(strip_accents(m.text), P.HANDOFF_INVITATION, ignore_case=True)
        return {f"{self.prefix}inv": F.min(F.when(m.is_bot & hit, m.ord))}

    def aggregates(self, m):
        if not self._invite():
            return {}
        inv = _anchor(self, "inv")
        after = m.ord > inv
        done = rlike_any(strip_accents(F.lower(m.text)), P.HANDOFF_COMPLETION)
        return {
            f"{self.prefix}inv_seen": F.max(inv.isNotNull()),
            f"{self.prefix}reply": F.min_by(m.text, F.when(m.is_user & after, m.ord)),
            f"{self.prefix}done": F.bool_or(m.is_bot & after & done),
            # for an invitation in an earlier segment
            f"{self.prefix}first_user": F.min_by(m.text, F.when(m.is_user, m.ord)),
            f"{self.prefix}any_done": F.bool_or(m.is_bot & done),
        }

    def merges(self):
        if not self._invite():
            return {}
        inv, reply, done, first_user, any_done = (
            f"{self.prefix}{n}" for n in ("inv_seen", "reply", "done", "first_user", "any_done")
        )
        return {
            inv: "any",
            reply: lambda l, r, _: F.when(l(inv), F.coalesce(l(reply), r(first_user))).otherwise(r(reply)),  # noqa: E741
            done: lambda l, r, _: F.when(l(inv), F.coalesce(l(done), F.lit(False)) | r(any_done)).otherwise(r(done)),  # noqa: E741
            first_user: "first",
            any_done: "any",
        }

    def outputs(self, a, prior, as_of):
        if not self._invite():
            return {
                "handoff_invitation_detected": F.lit(False),
                "handoff_response": F.lit("NO_INVITATION"),
                "handoff_finalized": F.lit(False),
            }
        detected = F.coalesce(a("inv_seen"), F.lit(False))
        reply = strip_accents(F.lower(a("reply")))
        accept = rlike_any(reply, P.HANDOFF_ACCEPT)
        decline = rlike_any(reply, P.HANDOFF_DECLINE)
        if self.p("strict", False):
            classified = F.when(decline, "DECLINED_HANDOFF").when(accept, "STARTED_HANDOFF")
        else:
            classified = F.when(accept, "STARTED_HANDOFF").when(decline, "DECLINED_HANDOFF")
        if self.p("skip_handoff_started", False):
            response = F.when(detected, F.lit("INVITATION_SENT")).otherwise(F.lit("NO_INVITATION"))
        else:
            response = (
                F.when(~detected, F.lit("NO_INVITATION"))
                .when(a("reply").isNull(), F.lit("NO_RESPONSE"))
                .otherwise(classified.otherwise(F.lit("UNCLEAR_RESPONSE")))
            )
        if self.p("skip_handoff_finalized", False) or self.p("skip_handoff_started", False):
            finalized = F.lit(False)
        else:
            finalized = (response == "STARTED_HANDOFF") & F.coalesce(a("done"), F.lit(False))
        return {
            "handoff_invitation_detected": detected,
            "handoff_response": response,
            "handoff_finalized": finalized,
        }


# --------------------------------------------------------------------------- X
class HumanTransfer(Feature):
    """Any bot row says the user is being passed to a person."""

    name = "HumanTransferProcessor"
    alias = "human_transfer"
    columns = [("human_transfer", T.BooleanType())]
    known_params = frozenset({"skip_human_transfer_detection", "strict"})

    def aggregates(self, m):
        if self.p("skip_human_transfer_detection", False):
            return {}
        phrases = P.HUMAN_TRANSFER
        if self.p("strict", False):
            phrases = [strip_accents_py(x) for x in phrases]
        hit = rlike_any(strip_accents(m.text), literal_regex(phrases), ignore_case=True)
        return {f"{self.prefix}hit": F.bool_or(m.is_bot & hit)}

    def merges(self):
        return {n: "any" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        if self.p("skip_human_transfer_detection", False):
            return {"human_transfer": F.lit(False)}
        return {"human_transfer": F.coalesce(a("hit"), F.lit(False))}


# --------------------------------------------------------------------------- C
class ConversationState(Feature):
    """HANDOFF / POST_VALIDACION / PRE_VALIDACION from flags computed earlier."""

    name = "ConversationStateProcessor"
    alias = "conversation_state"
    columns = [("conversation_state", T.StringType())]
    known_params = frozenset({"skip_state_determination"})

    def outputs(self, a, prior, as_of):
        if self.p("skip_state_determination", False):
            return {"conversation_state": F.lit("UNKNOWN")}
        handoff = prior.get("handoff_invitation_detected", F.lit(False))
        validated = prior.get("pre_validacion_detected", F.lit(False))
        state = (
            F.when(F.coalesce(handoff, F.lit(False)), F.lit("HANDOFF"))
            .when(F.coalesce(validated, F.lit(False)), F.lit("POST_VALIDACION"))
            .otherwise(F.lit("PRE_VALIDACION"))
        )
        return {"conversation_state": state}


# ------------------------------------------------------------------- rule inputs
class TransferContext(Feature):
    """B12 input: the last user message before the first transfer message."""

    name = "TransferContextFeature"
    alias = "transfer_context"
    columns = [("transfer_user_context", T.StringType())]
    known_params = frozenset()

    def anchors(self, m):
        hit = rlike_any(strip_accents(m.text), literal_regex(P.HUMAN_TRANSFER), ignore_case=True)
        return {f"{self.prefix}first": F.min(F.when(m.is_bot & hit, m.ord))}

    def aggregates(self, m):
        first = _anchor(self, "first")
        return {
            f"{self.prefix}ctx": F.max_by(m.text, F.when(m.is_user & (m.ord < first), m.ord)),
            f"{self.prefix}seen": F.max(first.isNotNull()),
            f"{self.prefix}last_user": F.max_by(m.text, F.when(m.is_user, m.ord)),  # for a transfer in a later segment
        }

    def merges(self):
        ctx, seen, last_user = (f"{self.prefix}{n}" for n in ("ctx", "seen", "last_user"))
        return {
            ctx: lambda l, r, _: F.when(l(seen), l(ctx)).when(r(seen), F.coalesce(r(ctx), l(last_user))),  # noqa: E741
            seen: "any",
            last_user: "last",
        }

    def outputs(self, a, prior, as_of):
        return {"transfer_user_context": a("ctx")}


class Recency(Feature):
    """Rule input: hours (double) since the last message and last user message."""

    name = "RecencyFeature"
    alias = "recency"
    columns = [("hours_since_last_message", T.DoubleType()), ("hours_since_last_user_message", T.DoubleType())]
    known_params = frozenset()

    def aggregates(self, m):
        return {f"{self.prefix}last": F.max(m.t), f"{self.prefix}last_user": F.max(F.when(m.is_user_l, m.t))}

    def merges(self):
        return {n: "max" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        return {
            "hours_since_last_message": seconds_between(as_of, a("last")) / F.lit(3600.0),
            "hours_since_last_user_message": seconds_between(as_of, a("last_user")) / F.lit(3600.0),
        }


class LastTimes(Feature):
    """Rule / prompt input: the time of the last message and last user message."""

    name = "LastTimesFeature"
    alias = "last_times"
    columns = [("last_message_time", T.TimestampType()), ("last_user_message_time", T.TimestampType())]
    known_params = frozenset()

    def aggregates(self, m):
        return {f"{self.prefix}last": F.max(m.t), f"{self.prefix}last_user": F.max(F.when(m.is_user_l, m.t))}

    def merges(self):
        return {n: "max" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        return {"last_message_time": a("last"), "last_user_message_time": a("last_user")}


class FollowUps(Feature):
    """B11 input: manual (operator) messages since the campaign start."""

    name = "FollowUpFeature"
    alias = "follow_ups"
    columns = [("follow_up_attempts", T.LongType())]
    known_params = frozenset({"campaign_start"})

    def aggregates(self, m):
        start = F.to_timestamp(F.lit(self.p("campaign_start", "1970-01-01 00:00:00")))
        is_op = F.coalesce(m.sender_l == "operator", F.lit(False))
        return {f"{self.prefix}n": F.count_if(is_op & (m.t >= start))}

    def merges(self):
        return {n: "sum" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        return {"follow_up_attempts": F.coalesce(a("n"), F.lit(0)).cast("bigint")}


class LeadName(Feature):
    """the name in the first bot greeting that holds one."""

    name = "LeadNameFeature"
    alias = "lead_name"
    columns = [("lead_name", T.StringType())]
    known_params = frozenset()

    def aggregates(self, m):
        name = lead_name(m.text)
        return {f"{self.prefix}first": F.min_by(name, F.when(m.is_bot & name.isNotNull(), m.ord))}

    def merges(self):
        return {n: "first" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        return {"lead_name": a("first")}


class Digest(Feature):
    """the conversation digest, folded with the other features."""

    name = "DigestFeature"
    alias = "digest"
    columns = [("conversation_digest", T.StringType())]
    known_params = frozenset()

    def aggregates(self, m):
        return {f"{self.prefix}{n}": c for n, c in digest_parts().items()}

    def merges(self):
        return {n: "sum" for n in self.aggregates(Msg())}

    def outputs(self, a, prior, as_of):
        return {"conversation_digest": digest_of(a("n"), a("high"), a("low"))}


# ------------------------------------------------------------------- registry
FEATURES: dict[str, type[Feature]] = {}


def register_feature(cls: type[Feature]) -> type[Feature]:
    """Make a feature class available by class name and by short alias."""
    if not (isinstance(cls, type) and issubclass(cls, Feature)):
        raise TypeError(f"{cls!r} is not a Feature subclass")
    FEATURES[cls.name] = cls
    FEATURES[cls.alias] = cls
    return cls


for _cls in (Temporal, Metadata, Template, Validation, Handoff, HumanTransfer, ConversationState,
             TransferContext, Recency, LastTimes, FollowUps, LeadName, Digest):
    register_feature(_cls)

# The reference's default chain order.
DEFAULT_CHAIN = ["temporal", "metadata", "handoff", "template", "validation", "conversation_state", "human_transfer"]


def load_feature(path: str) -> type[Feature]:
    """Import ``package.module.Class`` and register it; it must be a
    :class:`Feature` subclass (a bad path or class is a configuration error)."""
    import importlib

    module_name, _, cls_name = path.rpartition(".")
    if not module_name:
        raise ValueError(f"not a dotted path: {path!r}")
    try:
        cls = getattr(importlib.import_module(module_name), cls_name)
    except (ImportError, AttributeError) as exc:
        raise ValueError(f"cannot load feature {path!r}: {exc}") from exc
    return register_feature(cls)


def make_feature(name: str, params: dict | None = None) -> Feature:
    """Look a feature up by class name, alias or dotted path (known classes by
    their last part; other dotted paths are imported, see :func:`load_feature`)."""
    short = name.rsplit(".", 1)[-1]
    cls = FEATURES.get(name) or FEATURES.get(short)
    if cls is None and "." in name:
        cls = load_feature(name)
    if cls is None:
        raise ValueError(f"unknown feature {name!r}; known: {sorted(set(c.name for c in FEATURES.values()))}")
    return cls(dict(params or {}))


def select_chain(
    specs: list[Feature], skip: list[str] | None = None, only: list[str] | None = None
) -> list[Feature]:
    """Filter the chain by class name / alias ('run only' wins over 'skip')."""

    def hit(f: Feature, names: list[str]) -> bool:
        low = {n.lower() for n in names}
        return f.name.lower() in low or f.alias.lower() in low

    if only:
        return [f for f in specs if hit(f, only)]
    if skip:
        return [f for f in specs if not hit(f, skip)]
    return list(specs)


def feature_columns(specs: list[Feature]) -> list[tuple[str, T.DataType]]:
    """Output columns of a chain, first occurrence kept, in order."""
    seen: dict[str, T.DataType] = {}
    for f in specs:
        for n, t in f.columns:
            seen.setdefault(n, t)
    return list(seen.items())


def order_key(columns: list[str]) -> Column:
    """The order of messages in a conversation: time, source position where
    known, then content, so that no two different messages tie and the result
    does not depend on the order rows arrive in."""
    position = F.col("src_ord").cast("long") if "src_ord" in columns else F.lit(None).cast("long")
    return F.struct(
        F.col("creation_time").alias("t"), position.alias("i"), F.col("msg_from").alias("s"), F.col("message").alias("m")
    )


def with_order_key(messages: DataFrame) -> DataFrame:
    """Attach the ordering key used by order-dependent features."""
    return messages.withColumn(ORD, order_key(messages.columns))


def state_merges(specs: list[Feature]) -> dict[str, Merge] | None:
    """The merge of every state column of a chain, or None if one is not declared."""
    out: dict[str, Merge] = {}
    for f in specs:
        declared = f.merges()
        for name in f.aggregates(Msg()):
            if name not in declared:
                return None
            how = declared[name]
            out[name] = MERGES[how] if isinstance(how, str) else how
    return out


def _base(messages: DataFrame, key: str) -> DataFrame:
    needed = [key, "creation_time", "msg_from", "message"] + (["src_ord"] if "src_ord" in messages.columns else [])
    return with_order_key(messages.select(*needed, *[c for c in (SEGMENT,) if c in messages.columns]))


def segment_states(messages: DataFrame, specs: list[Feature], key: str = "cleaned_phone") -> DataFrame:
    """The state of each ``(key, segment)``: one exchange, in which the anchors
    are window aggregates and the state follows on the same partitioning."""
    m = Msg(key)
    base = _base(messages, key)
    anchors = {n: c for f in specs for n, c in f.anchors(m).items()}
    if anchors:
        together = Window.partitionBy(key, SEGMENT)
        base = base.withColumns({n: c.over(together) for n, c in anchors.items()})
    aggs = {n: c for f in specs for n, c in f.aggregates(m).items()} or {"__rows": F.count(F.lit(1))}
    return base.groupBy(key, SEGMENT).agg(*[c.alias(n) for n, c in aggs.items()])


def feature_outputs(states: DataFrame, specs: list[Feature], as_of: str, key: str = "cleaned_phone") -> DataFrame:
    """The chain's columns from one state per key; later features overwrite
    earlier columns of the same name."""
    as_of_col = F.to_timestamp(F.lit(as_of))
    cols: dict[str, Column] = {}
    for f in specs:
        cols.update(f.outputs(Agg(f.prefix), dict(cols), as_of_col))
    return states.select(F.col(key), *[c.alias(n) for n, c in cols.items()])


def conversation_features(
    messages: DataFrame,
    specs: list[Feature],
    as_of: str = AS_OF_DEFAULT,
    key: str = "cleaned_phone",
    cuts: Cuts | None = None,
) -> DataFrame:
    """Fold a feature chain over each conversation; one row per key with
    the chain's columns.

    ``cuts`` says where hot conversations are cut; by default they are looked
    for (a sketch of the key column, run at once) if the chain has anchors and
    can be merged."""
    m = Msg(key)
    if not any(f.anchors(m) for f in specs):
        aggs = {n: c for f in specs for n, c in f.aggregates(m).items()} or {"__rows": F.count(F.lit(1))}
        states = _base(messages, key).groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
        return feature_outputs(states, specs, as_of, key)
    merges = state_merges(specs)
    if merges is None:
        cuts = Cuts()
    elif cuts is None:
        cuts = cuts_of(messages, key)
    states = segment_states(cuts.assign(messages, key), specs, key)
    if cuts.rows:
        states = merge_states(states, merges, [key], SEGMENT)
    return feature_outputs(states, specs, as_of, key)


def chain(names_and_params: list[tuple[str, dict]] | list[str]) -> list[Feature]:
    """Build a chain from names or ``(name, params)`` pairs."""
    out = []
    for item in names_and_params:
        if isinstance(item, str):
            out.append(make_feature(item))
        else:
            out.append(make_feature(item[0], item[1]))
    return out


FeatureFactory = Callable[[dict], Feature]

"""The detectors again, as declarative programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_email
from .program import Program, Read, State, Write

_PAIR = lambda a, b: (F.least(a, b), F.greatest(a, b))


def simple_spam() -> Program:
    """Rules ``spam`` (messages with f, nf and is_spam) and what leads to them; tables messages and friendships."""
    p = Program(State("friends", "min", ("lo long", "hi long")), State("sent_friend", "sum", ("user long",)), State("sent_other", "sum", ("user long",)), State("spam", "count"), State("spam_by_user", "count", ("user long",)), State("spam_users", "set"))
    p.rule("befriend", "friendships", writes=[Write("friends", _PAIR("user_a", "user_b"), F.col("ts"))])
    friend = F.col("since").isNotNull()
    p.rule("message", "messages", reads={"since": Read("friends", _PAIR("sender", "recipient"))}, writes=[Write("sent_friend", (F.col("sender"),), friend.cast("long")), Write("sent_other", (F.col("sender"),), (~friend).cast("long"))])
    spam = (F.col("nf") > 2 * F.col("f")) & (F.col("f") + F.col("nf") > 5)
    p.rule("spam", "messages", reads={"f": Read("sent_friend", (F.col("sender"),), 0), "nf": Read("sent_other", (F.col("sender"),), 0)}, columns={"is_spam": spam}, writes=[Write("spam", when=F.col("is_spam")), Write("spam_by_user", (F.col("sender"),), when=F.col("is_spam")), Write("spam_users", value=F.col("sender"), when=F.col("is_spam"))])
    return p


def address_spam() -> Program:
    """``simple_spam`` and a rule ``address_spam`` on the same row that also asks for the address' share of mail."""
    p = simple_spam()
    p.states |= {s.name: s for s in (State("mail", "sum", ("ip int",)), State("by_ip", "count", ("ip int",)), State("address_spam", "count"))}
    p.rule("address", "messages", writes=[Write("mail", (F.col("sender_ip"),), has_email(F.col("content")).cast("long")), Write("by_ip", (F.col("sender_ip"),))])
    both = F.col("is_spam") & (F.col("mail") / F.col("all_mail") > 0.2)
    return p.rule("address_spam", "messages", extends="spam", reads={"mail": Read("mail", (F.col("sender_ip"),), 0), "all_mail": Read("by_ip", (F.col("sender_ip"),), 0)}, columns={"is_address_spam": both}, writes=[Write("address_spam", when=F.col("is_address_spam"))])


def word_counts() -> Program:
    p = Program(State("words", "count", ("word string",)))
    return p.rule("count", "words", writes=[Write("words", (F.col("word"),))])


def popularity() -> Program:
    """Views of each product and of all; the rule ``view`` has both as of each view."""
    p = Program(State("by_sku", "count", ("sku long",)), State("all_views", "count"))
    p.rule("count", "views", writes=[Write("by_sku", (F.col("sku"),)), Write("all_views")])
    return p.rule("view", "views", reads={"views": Read("by_sku", (F.col("sku"),), 0), "total": Read("all_views", default=0)}, columns={"popularity": F.col("views") / F.col("total")})


def response_times() -> Program:
    """Rule ``answer``: waited is the time since the recipient last wrote to the sender; state ``mean_wait`` averages it."""
    p = Program(State("last", "max", ("from_user long", "to_user long")), State("mean_wait", "avg", ("user long",)), State("answered", "avg", ("user long",)))
    p.rule("note", "messages", writes=[Write("last", (F.col("sender"), F.col("recipient")), F.col("ts"))])
    waited = F.col("ts") - F.col("last_back")
    return p.rule("answer", "messages", reads={"last_back": Read("last", (F.col("recipient"), F.col("sender")))}, columns={"waited": waited}, writes=[Write("mean_wait", (F.col("sender"),), waited, F.col("last_back").isNotNull()), Write("answered", (F.col("sender"),), F.col("last_back").isNotNull().cast("long"))])

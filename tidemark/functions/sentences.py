"""Sentences of reports and notices as Column expressions over their figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sentences of an exam report, in the order in which they are shown.
REPORT = {
    "records": "시험기간 기록 %d회, 그중 평소와 달랐던 기록 %d회에 이유가 붙었어요.",
    "reason": "%s 있던 날 %s 심박이 평소보다 %+d bpm 높게 기록됐어요 (%d회).",
    "redness": "음주 기록 중 %d회는 볼 붉은기도 평소보다 높았어요.",
    "unexplained": "이유 없이 평소와 달랐던 기록 %d회는 날짜와 함께 따로 보관했어요 (%s).",
    "all_explained": "이유 없이 평소와 달랐던 기록은 없어요.",
    "recovered": "시험이 끝난 뒤 아침 심박은 %s에 평소 범위로 돌아왔어요.",
    "not_recovered": "시험이 끝난 뒤 아침 심박이 평소 범위로 돌아온 기록은 아직 없어요.",
}

#: Fixed values: (title, body) of the notices by status, and of a question by the baseline's mode.
NOTICES = {
    "ALERT": ("%d일째 이유가 남지 않아요", "최근 %d일간 평소와 다른 변화가 생활 기록으로 설명되지 않습니다."),
    "ASK": ("심박이 평소보다 높아요", "이미 잡힌 기록 중에서, 겹칠 수 있는 것만 확인할게요."),
    "early": ("심박 변화가 감지됐어요", "최근 안정 상태보다 심박이 높게 유지되고 있어요."),
    "adapting": ("최근 같은 기록보다 심박이 높아요", "겹칠 수 있는 이유만 확인할게요."),
}


def particle(word: Column, closed: str, opened: str) -> Column:
    """The word with the particle that its last Hangul syllable asks for; a part in brackets at the end is passed over."""
    said = F.when(word.endswith(")"), F.split_part(word, F.lit("("), F.lit(1))).otherwise(word)
    place = F.ascii(F.substring(said, -1, 1)) - 0xAC00  # a syllable's final consonant is its place modulo 28
    return F.concat(word, F.when(place.between(0, 11171) & (place % 28 != 0), closed).otherwise(opened))


def report_sentences(records: Column, with_reason: Column, reasons: Column, redness: Column, unexplained_days: Column, recovery_day: Column, unexplained: Column) -> Column:
    """Sentences of a report. `reasons`: array of (reason, subs, routine, median_delta, n) in their order; days are dates."""
    day = lambda d: F.date_format(d, "MM/dd")

    def of(r: Column) -> Column:
        subs = F.when(F.size(r["subs"]) > 0, F.concat(F.lit("("), F.array_join(r["subs"], "·"), F.lit(")"))).otherwise("")
        rise = F.bround(F.coalesce(r["median_delta"], F.lit(0.0))).cast("bigint")
        return F.format_string(REPORT["reason"], particle(F.concat(r["reason"], subs), "이", "가"), r["routine"], rise, r["n"])

    some = lambda said, when: F.when(when, F.array(said)).otherwise(F.array().cast("array<string>"))
    dates = F.array_join(F.array_sort(F.array_distinct(F.transform(unexplained_days, day))), ", ")
    left = F.when(unexplained > 0, F.format_string(REPORT["unexplained"], unexplained, dates)).otherwise(REPORT["all_explained"])
    back = F.when(recovery_day.isNotNull(), F.format_string(REPORT["recovered"], day(recovery_day))).otherwise(REPORT["not_recovered"])
    return F.concat(F.array(F.format_string(REPORT["records"], records, with_reason)), F.transform(reasons, of), some(F.format_string(REPORT["redness"], redness), redness > 0), F.array(left, back))


def notice_text(status: Column, mode: Column, k: Column) -> tuple[Column, Column]:
    """(title, body) of a state's notice; NULL for a state that gives none."""
    asked = F.when((status == "ASK") & mode.isin("early", "adapting"), mode)
    key = F.coalesce(asked, status)

    def said(part: int) -> Column:
        out = F.when(key == "ALERT", F.format_string(NOTICES["ALERT"][part], k))
        for name in ("ASK", "early", "adapting"):
            out = out.when((status == "ASK") & (key == name), NOTICES[name][part])
        return out

    return said(0), said(1)

"""Category recodes as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Incident types that are merged, by new label, first match wins.
TYPE_GROUPS: dict[str, tuple[str, ...]] = {
    "Burglary - Residential": ("Distraction Burglary",),
    "other - admin": (
        "Assistance to Other Agencies",
        "CRB Use Only",
        "CSI To Be Informed",
        "External System",
        "Found Stolen Vehicle",
        "Message to Pass/OOF Enquiries",
        "PNC Markers",
        "Police Vehicle Recovery",
        "Pre-Planned Events",
        "Stop Search",
        "Training",
    ),
    "alarms": (
        "Alarm - Activation",
        "Alarm - No Response",
        "Audible Only Alarm",
        "Insecure Premises",
        "Police Installed Alarm",
        "Unauthorised Encampment",
    ),
    "warrant/bail issue": (
        "Bail Breaches/Wanted Person",
        "Bail/Curfew/Wanted",
        "Prison Licence Recall",
        "Warrant Crown Court",
    ),
    "animals": ("Domestic Animal Concern", "Wildlife Matters"),
    "firearms": ("Firearms - Non Notifiable Crime", "Firearms Involved Crime"),
    "traffic collision": ("RTC", "RTC - Damage Only"),
}
RARE_LABEL = "other - minor"

# Call origins that are merged or renamed, and the one that means "not known".
ORIGIN_GROUPS: dict[str, tuple[str, ...]] = {
    "public non-emergency": (
        "Alarm Company",
        "Email (to Public Contact Mailbox)",
        "Helpdesk",
        "Public Non Emergency (inc. Door Phones and PCPs)",
        "Single Online Home",
        "Social Media",
    ),
    "other emergency services": ("Other Emergency Services (inc. Other Forces)",),
    "police generated": ("Police Generated (inc. Call Sign / Collar Numbers)",),
}
UNKNOWN_ORIGINS = ("Unknown Choice List Value",)


def merge_categories(
    value: Column,
    groups: Mapping[str, Sequence[str]],
    rare: Column | None = None,
    rare_label: str = RARE_LABEL,
) -> Column:
    """First matching group's label, then `rare_label` where `rare` holds, else `value` itself."""
    matched = F.lit(None).cast("string")
    for label, members in reversed(list(groups.items())):
        matched = F.when(value.isin(list(members)), label).otherwise(matched)
    rest = value if rare is None else F.when(rare, rare_label).otherwise(value)
    return F.coalesce(matched, rest)


def merge_origins(
    value: Column,
    groups: Mapping[str, Sequence[str]] = ORIGIN_GROUPS,
    unknown: Sequence[str] = UNKNOWN_ORIGINS,
) -> Column:
    """Merged origin; unknown values become NULL."""
    return F.when(~value.isin(list(unknown)), merge_categories(value, groups))


def yes_no(flag: Column) -> Column:
    """1 to Yes, 0 to No, anything else to NULL."""
    return F.when(flag == 1, "Yes").when(flag == 0, "No")

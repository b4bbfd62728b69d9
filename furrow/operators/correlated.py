"""Columns of one table that belong together, made from the same draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import Draws, later
from .providers import FIRST_NAMES, LAST_NAMES, PROVIDERS, Context

#: Places of addresses: city, state and a postal code of that city.
PLACES = [
    ("Montgomery", "Alabama", "36104"), ("Juneau", "Alaska", "99801"), ("Phoenix", "Arizona", "85007"), ("Little Rock", "Arkansas", "72201"),
    ("Sacramento", "California", "95814"), ("Denver", "Colorado", "80203"), ("Hartford", "Connecticut", "06106"), ("Dover", "Delaware", "19901"),
    ("Tallahassee", "Florida", "32301"), ("Atlanta", "Georgia", "30334"), ("Honolulu", "Hawaii", "96813"), ("Boise", "Idaho", "83702"),
    ("Springfield", "Illinois", "62701"), ("Indianapolis", "Indiana", "46204"), ("Des Moines", "Iowa", "50319"), ("Topeka", "Kansas", "66612"),
    ("Frankfort", "Kentucky", "40601"), ("Baton Rouge", "Louisiana", "70802"), ("Augusta", "Maine", "04330"), ("Annapolis", "Maryland", "21401"),
    ("Boston", "Massachusetts", "02133"), ("Lansing", "Michigan", "48933"), ("Saint Paul", "Minnesota", "55155"), ("Jackson", "Mississippi", "39201"),
    ("Jefferson City", "Missouri", "65101"), ("Helena", "Montana", "59601"), ("Lincoln", "Nebraska", "68509"), ("Carson City", "Nevada", "89701"),
    ("Concord", "New Hampshire", "03301"), ("Trenton", "New Jersey", "08608"), ("Santa Fe", "New Mexico", "87501"), ("Albany", "New York", "12207"),
    ("Raleigh", "North Carolina", "27601"), ("Bismarck", "North Dakota", "58501"), ("Columbus", "Ohio", "43215"), ("Oklahoma City", "Oklahoma", "73105"),
    ("Salem", "Oregon", "97301"), ("Harrisburg", "Pennsylvania", "17101"), ("Providence", "Rhode Island", "02903"), ("Columbia", "South Carolina", "29201"),
    ("Pierre", "South Dakota", "57501"), ("Nashville", "Tennessee", "37219"), ("Austin", "Texas", "78701"), ("Salt Lake City", "Utah", "84103"),
    ("Montpelier", "Vermont", "05609"), ("Richmond", "Virginia", "23219"), ("Olympia", "Washington", "98501"), ("Charleston", "West Virginia", "25305"),
    ("Madison", "Wisconsin", "53703"), ("Cheyenne", "Wyoming", "82001"),
]
STREETS = ["Acorn Way", "Birch Road", "Canal Street", "Dune Lane", "Eagle Court", "Forge Street", "Garden Row", "High Street", "Juniper Drive", "Mill Road"]


def _address(d: Draws, name: str, base: Column) -> dict[str, Column]:
    place = F.element_at(F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state"), F.lit(z).alias("zip")) for c, s, z in PLACES]), (d.integer(0, len(PLACES), name, 0) + 1).cast("int"))
    street = F.concat_ws(" ", d.integer(100, 9999, name, 1).cast("string"), d.pick(STREETS, name, 2))
    return {"StreetAddress": street, "City": place["city"], "State": place["state"], "ZipCode": place["zip"], "PostalCode": place["zip"], "Country": F.lit("United States"), "CountryCode": F.lit("US")}


def _geo(d: Draws, name: str, base: Column) -> dict[str, Column]:
    return {"Latitude": F.round(d.between(25, 48, name, 0), 6), "Longitude": F.round(d.between(-125, -70, name, 1), 6)}


def _person(d: Draws, name: str, base: Column) -> dict[str, Column]:
    first, last = d.pick(FIRST_NAMES, name, 0), d.pick(LAST_NAMES, name, 1)
    suffix = F.when(d.id == 0, "").otherwise(F.concat(F.lit("."), d.id.cast("string")))
    return {
        "FirstName": first,
        "LastName": last,
        "FullName": F.concat_ws(" ", first, last),
        "Email": F.lower(F.concat(first, F.lit("."), last, suffix, F.lit("@example.com"))),
        "Username": F.lower(F.concat(first, F.lit("."), last, d.id.cast("string"))),
    }


def _temporal(d: Draws, name: str, base: Column) -> dict[str, Column]:
    ago = d.integer(30, 365, name, 0)
    after = F.lit(1) + F.floor(d.uniform(name, 1) * (ago - 1))
    gone = d.integer(1, 30, name, 2)
    created = later(base, -ago)
    updated = later(created, after)
    deleted = F.when(d.uniform(name, 3) < 0.1, later(updated, gone))
    return {"CreatedAt": created, "UpdatedAt": updated, "DeletedAt": deleted}


def _range(d: Draws, name: str, base: Column) -> dict[str, Column]:
    start = F.date_add(base.cast("date"), d.integer(-30, 60, name, 0).cast("int"))
    return {"StartDate": start, "EndDate": F.date_add(start, d.integer(1, 90, name, 1).cast("int"))}


MAKERS = {"Address": _address, "GeoCoordinates": _geo, "PersonIdentity": _person, "Temporal": _temporal, "TemporalRange": _range}


def group_value(group: str, meaning: str, draws: Draws, base_time: Column, column: str) -> Column:
    """A member's value; what isn't a member gets its own provider's."""
    made = MAKERS[group](draws, f"group:{group}", base_time)
    return made[meaning] if meaning in made else PROVIDERS[meaning][1](Context(draws, column, base_time))

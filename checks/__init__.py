"""Registered queries over the provided tables, each with the SQL that must agree with it."""

from checks import console, features, modelling, policy, preparation, reports, streams

ALL = (preparation, features, reports, policy, console, streams, modelling)

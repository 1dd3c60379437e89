"""Named bundles of lazy results, as an analyst asks for them together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import cdr, cross_target, devices, ip_events, presence, sessions, spots, towers


def call_bundle(df: DataFrame, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    named = {
        "summary": cdr.summary, "activity": cdr.activity, "hourly": cdr.hourly, "daily": cdr.daily, "weekly": cdr.weekly,
        "monthly": cdr.monthly, "contact_categories": cdr.category_counts, "call_types": cdr.call_type_counts,
        "contact_ranking": cdr.contact_ranking, "contact_network": cdr.contact_network, "locations": cdr.location_overview,
        "towers": cdr.tower_profile, "home_tower": cdr.home_tower, "work_tower": cdr.work_tower, "devices": cdr.device_summary,
        "sims": cdr.sim_summary, "review_indicators": cdr.review_indicators,
    }
    return {n: f(df, by=by) for n, f in named.items()} | {
        "movement": cdr.movement(df), "transitions": cdr.transitions(df), "changes": cdr.change_review(df),
        "top_contacts": cdr.top_contacts(df, by=by), "full_contacts": cdr.full_contact_summary(df),
    }


def tower_bundle(df: DataFrame) -> dict[str, DataFrame]:
    rolled = presence.rollup(df)
    out = {
        "summary": towers.summary(df), "operators": towers.operator_summary(df), "cells": towers.cell_summary(df),
        "call_types": towers.call_type_summary(df), "subscribers": towers.subscriber_summary(df), "repeat_visitors": towers.repeat_visitors(df),
        "imei": towers.identifier_summary(df, "imei"), "imsi": towers.identifier_summary(df, "imsi"),
        "shared_imei": towers.shared_identifiers(df, "imei"), "shared_imsi": towers.shared_identifiers(df, "imsi"),
        "hourly": towers.hourly(df), "daily": towers.daily(df), "night": towers.night_events(df), "movements": towers.movements(df),
        "transitions": towers.transition_summary(df), "indicators": towers.indicators(df), "presence": rolled,
    }
    return out | {f"presence_{n}": presence.bucket(rolled, n) for n in presence.BUCKETS}


def spot_bundle(df: DataFrame, spot_ids: list[str]) -> dict[str, DataFrame]:
    return {
        "spots": spots.spot_summary(df), "subscribers": spots.subscriber_spots(df), "matrix": spots.presence_matrix(df, spot_ids),
        "continuity": spots.device_continuity(df), "shared_imei": spots.shared_across(df, "imei"), "shared_imsi": spots.shared_across(df, "imsi"),
        "sequence": spots.sequence(df), "leads": spots.spot_leads(df),
    }


def session_bundle(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": sessions.summary(df), "subscribers": sessions.subscriber_summary(df), "imei": sessions.identity_summary(df, "imei"),
        "imsi": sessions.identity_summary(df, "imsi"), "ips": sessions.ip_summary(df), "durations": sessions.duration_bins(df),
        "hourly": sessions.hourly(df), "quality": sessions.quality(df), "networks": sessions.network_summary(df),
        "technology": sessions.counts(df, "technology"), "presence": presence.rollup(df, "session_start", "total_volume"),
    }


def ip_bundle(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "metrics": ip_events.metrics(df), "allocations": ip_events.allocations(df), "subscribers": ip_events.subscriber_summary(df),
        "imei": ip_events.identity_summary(df, "imei"), "imsi": ip_events.identity_summary(df, "imsi"), "ports": ip_events.port_summary(df),
        "endpoints": ip_events.endpoint_summary(df), "cells": ip_events.cell_summary(df), "movement": ip_events.movement_summary(df),
        "hourly": ip_events.hourly(df), "quality": ip_events.quality(df),
    }


def cross_bundle(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "overview": cross_target.overview(df), "common_numbers": cross_target.common_numbers(df), "direct_links": cross_target.direct_links(df),
        "common_towers": cross_target.common_towers(df), "common_devices": cross_target.common_devices(df), "common_sims": cross_target.common_sims(df),
        "contact_map": cross_target.contact_map(df), "movement": cross_target.movement_rows(df), "alerts": cross_target.alerts(df),
    }


def device_bundle(calls: DataFrame, packet: DataFrame, ips: DataFrame, identifier: str) -> dict[str, DataFrame]:
    line = devices.unified_timeline(calls, packet, ips, identifier)
    out = {"timeline": line, "identities": devices.associated_identities(line), "sources": devices.source_status(line)}
    for name, got in (("call", devices.call_bundle(calls, identifier)), ("session", devices.session_bundle(packet, identifier)), ("ip", devices.ip_bundle(ips, identifier))):
        out |= {f"{name}_{k}": v for k, v in got.items()}
    return out

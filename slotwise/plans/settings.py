"""Settings of an application, narrowed to a job and to one of its inputs or outputs.

``job.<name>.<key>`` overrides ``<key>`` for one job; below it, ``input.<name>.<key>`` and ``output.<name>.<key>``
override it for one parameter.
"""

from __future__ import annotations

from collections.abc import Mapping

JOB = "job."


def job_settings(settings: Mapping[str, str], job: str, defaults: Mapping[str, str] | None = None) -> dict[str, str]:
    general = {k: v for k, v in settings.items() if not k.startswith(JOB)}
    return {**(defaults or {}), **general, **with_prefix(settings, f"{JOB}{job}.")}


def input_settings(of_job: Mapping[str, str], name: str) -> dict[str, str]:
    return _parameter_settings(of_job, f"input.{name}.")


def output_settings(of_job: Mapping[str, str], name: str) -> dict[str, str]:
    return _parameter_settings(of_job, f"output.{name}.")


def with_prefix(settings: Mapping[str, str], prefix: str) -> dict[str, str]:
    """The settings below a prefix, without it; ``hadoop.`` ones can be passed to a reader as options."""
    return {k.removeprefix(prefix): v for k, v in settings.items() if k.startswith(prefix)}


def _parameter_settings(of_job: Mapping[str, str], prefix: str) -> dict[str, str]:
    general = {k: v for k, v in of_job.items() if not k.startswith(("input.", "output."))}
    return {**general, **with_prefix(of_job, prefix)}

"""Failures of sandboxed runs as data: classes by backend, capability matching, engine descriptions, device choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGSYS = 31


def classify(runs: DataFrame) -> DataFrame:
    """runs (backend, exit_code, timed_out, seconds, timeout_seconds, syscall_filter, trap, memory, memory_cap) with failure.

    Each backend has its own reading of exit codes; null is success."""
    code = F.col("exit_code")
    signalled = code.between(129, 192)
    bubblewrap = (
        F.when(F.col("timed_out"), "timeout").when(F.col("syscall_filter") & (code == 128 + SIGSYS), "syscall_blocked")
        .when(signalled | (code < 0), "crashed").when(code != 0, "exit_status")
    )
    oci = (
        F.when(F.col("timed_out"), "timeout").when((code == 137) & (F.col("seconds") >= F.col("timeout_seconds") - 0.5), "timeout").when(code == 137, "out_of_memory")
        .when(code.between(125, 127), "engine_error").when(signalled, "crashed").when(code != 0, "exit_status")
    )
    wasm = (
        F.when((F.col("trap") == "interrupt") | F.col("timed_out"), "timeout").when(F.col("trap") == "fuel", "cpu_limit").when(F.col("trap") == "link", "engine_error")
        .when(F.col("trap").isNotNull() & (F.col("memory") >= F.col("memory_cap")), "out_of_memory").when(F.col("trap").isNotNull(), "crashed").when(code != 0, "exit_status")
    )
    other = F.when(F.col("timed_out"), "timeout").when(code < 0, "crashed").when(code != 0, "exit_status")
    kind = F.when(F.col("backend") == "bubblewrap", bubblewrap).when(F.startswith("backend", F.lit("oci")), oci).when(F.col("backend") == "wasmtime", wasm).otherwise(other)
    return runs.withColumn("failure", kind)


def select_backend(needs: DataFrame, backends: DataFrame) -> DataFrame:
    """(need_id, backend, verdict): the first backend by rank that has all capabilities needed and is available.

    needs: need_id, needed array. backends (a handful, one row each): backend, rank, capabilities array, available."""
    listed = backends.agg(F.array_sort(F.collect_list(F.struct("rank", "backend", "capabilities", "available"))).alias("all"))
    joined = needs.crossJoin(F.broadcast(listed))
    capable = F.filter("all", lambda x: F.size(F.array_except(F.col("needed"), x["capabilities"])) == 0)
    ready = F.filter(capable, lambda x: x["available"])
    verdict = F.when(F.size(ready) > 0, "selected").when(F.size(capable) > 0, "capable but unavailable").otherwise("unsupported")
    return joined.select("need_id", F.get(ready, F.lit(0))["backend"].alias("backend"), verdict.alias("verdict"))


def engine_info(info: Column) -> Column:
    """struct<engine, version, rootless, cgroup> of a container engine's own description, in either of two shapes."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(info, p) for p in paths])
    podman = F.get_json_object(info, "$.host").isNotNull()
    rootless = F.coalesce(F.get_json_object(info, "$.host.security.rootless") == "true", F.get_json_object(info, "$.SecurityOptions").contains("rootless"), F.lit(False))
    return F.struct(F.when(podman, "podman").otherwise("docker").alias("engine"), get("$.version.Version", "$.ServerVersion").alias("version"), rootless.alias("rootless"), get("$.host.cgroupVersion", "$.CgroupVersion").alias("cgroup"))


def choose_device(requests: DataFrame) -> DataFrame:
    """requests (policy never, optional or required; gpu_available; asked cpu, gpu or null) with device, null if refused."""
    device = (
        F.when((F.col("policy") == "never") & (F.col("asked") == "gpu"), None).when((F.col("policy") == "required") & ((F.col("asked") == "cpu") | ~F.col("gpu_available")), None)
        .when((F.col("asked") == "gpu") & ~F.col("gpu_available"), None).when(F.col("policy") == "required", "gpu").when(F.col("policy") == "never", "cpu")
        .otherwise(F.coalesce("asked", F.when(F.col("gpu_available"), "gpu").otherwise("cpu")))
    )
    return requests.withColumn("device", device)


def describe_failure(failure: Column, exit_code: Column, stderr: Column) -> Column:
    """A failed run in words, with the last line that says something."""
    lines = F.filter(F.split(F.coalesce(stderr, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    last = F.when(F.size(lines) > 0, F.concat(F.lit(": "), F.element_at(lines, -1))).otherwise("")
    words = (
        F.when(failure == "timeout", "took too long").when(failure == "out_of_memory", "ran out of memory").when(failure == "crashed", "crashed")
        .when(failure == "exit_status", F.concat(F.lit("ended with status "), exit_code.cast("string"))).otherwise(F.replace(failure, F.lit("_"), F.lit(" ")))
    )
    return F.concat(words, last)


def bounded_capture(text: Column, limit: int) -> Column:
    """struct<text, truncated> of at most limit characters of a run's output."""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))

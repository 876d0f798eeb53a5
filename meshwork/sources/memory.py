"""Memory of the driver that nothing holds any more, handed back to the system.

The C library keeps freed blocks in an arena for each of many threads, of which
a driver has hundreds (an exchange, a broadcast and each clean-up run in threads
of their own), so what its compilers, buffers and results once took stays with
the process.  The driver's Python keeps the results that it has fetched in the
same way.
"""

from __future__ import annotations

import ctypes
import gc
import time

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

#: Seconds between two times, at least.
EVERY = 2.0

_last = -EVERY


def _trim_jvm(spark: SparkSession) -> None:
    """The JVM's own command System.trim_native_heap, by reflection, as the server's class is not open to py4j."""
    context = spark.sparkContext
    jvm, new = context._jvm, context._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    given = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
    types, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for k in range(4):
        types[k], values[k] = kinds[k], given[k]
    named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def hand_back(spark: SparkSession) -> None:
    """Return freed memory of the driver's Python and JVM; where a C library or a JVM cannot, it stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    try:
        _trim_jvm(spark)
    except Py4JError:  # the JVM has no such command
        pass


def hand_back_now_and_then(spark: SparkSession) -> None:
    """``hand_back``, unless that was ``EVERY`` seconds ago or less."""
    global _last
    if time.monotonic() - _last > EVERY:
        hand_back(spark)
        _last = time.monotonic()

"""Time-sliced datasets and event streams on Spark."""

from slotwise.functions.cron import audit_schedules, next_fire, slot_of, stride, stride_minutes, with_cron_fields
from slotwise.functions.timeparts import (
    format_nominal, from_millis, parse_nominal, render_template, slot_time, time_parts, to_millis, with_time_parts,
)
from slotwise.functions.uris import parse_view_uri, split_uri
from slotwise.operators.readiness import (
    mark_ready, missing_slots, pending_slots, ready_marks, ready_slots,
)
from slotwise.operators.sinks import save_nonempty, write_time_partitioned, write_view
from slotwise.operators.slots import events_per_slot, fire_slots, instance_at, is_slot, slots_with_data
from slotwise.operators.transforms import copy_view, count_by_key, keys, odd_users, reconcile, row_count, union_inputs
from slotwise.plans.jobs import Job, Schedule, backfill, job, run_at, run_schedules, run_stream
from slotwise.session import build_session, shared_dir
from slotwise.sources.datasets import (
    View, covering_partitions, ensure_dataset, list_partitions, read_at, read_dataset, read_view, refine,
)
from slotwise.sources.generator import generate_events, stream_events
from slotwise.sources.topics import Topic, decode, encode, read_topic, write_topic
from slotwise.streaming.sinks import for_each_batch, stream_to_dataset, stream_to_topic

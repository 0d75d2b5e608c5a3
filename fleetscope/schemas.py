"""Read schemas of the telemetry tables. Every table leads with ``source`` (the host); ``ts`` is epoch seconds; null means unknown."""

# Columns and types of the stored tables.
METRICS_RAW = "source string, ts double, cpu_total double, cpu_per_core array<double>, cpu_max_core double, cpu_freq_mhz double, cpu_perf_percent double, mem_used_mb double, mem_avail_mb double, mem_percent double, swap_used_mb double, disk_read_bps double, disk_write_bps double, disk_read_iops double, disk_write_iops double, disk_queue double, disk_resp_ms double, net_rx_bps double, net_tx_bps double, ctx_switches_ps double, proc_count long, thread_count long"
GPU_METRICS = "source string, ts double, gpu_index long, util_percent double, mem_util_percent double, vram_used_mb double, vram_total_mb double, temp_c double, power_w double, power_limit_w double, pstate long, clock_sm_mhz long, clock_mem_mhz long, fan_percent double, throttle_reasons string"
PROCESS_METRICS = "source string, ts double, pid long, name string, cpu_percent double, rss_mb double, io_read_bps double, io_write_bps double, handles long, threads long, tier int, foreground boolean"
PROCESS_EVENTS = "source string, ts double, event string, pid long, ppid long, name string, exe string, username string"
NET_CONNECTIONS = "source string, ts double, pid long, name string, laddr string, lport int, raddr string, rport int, status string, family string"
SYSTEM_EVENTS = "source string, ts double, event string, gap_seconds double, detail string"
SELF_TELEMETRY = "source string, ts double, cpu_percent double, rss_mb double, private_mb double, peak_wset_mb double, page_faults long, threads long, handles long, queue_depth long, drop_count long, write_latency_ms double, throttle_level int, active string"
FAULTS = "source string, id long, scenario string, ts_start double, ts_end double, pid long, params string, ramp boolean, completed boolean, notes string"
SIGNALS = "source string, ts double, detector string, score double, severity string, features string, run_id long"
CONTRIBUTORS = "array<struct<name:string,share:double,delta:double,after:double,pids:array<long>,lead_s:double,is_new:boolean>>"
INCIDENTS = f"source string, id long, ts_start double, ts_end double, severity string, bottleneck string, title string, explanation string, contributors {CONTRIBUTORS}, evidence array<string>, detectors array<string>, signal_count long, peak_score double, suppressed_by long, notified boolean, notify_skipped string, user_label string, labeled_at double, auto_label string, auto_label_reason string, auto_labeled_at double"
INCIDENT_SIGNALS = "source string, incident_id long, ts double, detector string, score double"
FINGERPRINTS = "source string, name string, regime string, stat string, p50 double, p95 double, p99 double, maximum double, samples long, days long, built_at double"
PROGRAM_INFO = "source string, name string, description string, company string, attempts int, checked_at double, foreground_seen boolean"
HOST_PROFILE = "source string, cores double, physical_cores double, ram_mb double, swap_total_mb double"

TABLES = {
    "metrics_raw": METRICS_RAW, "gpu_metrics": GPU_METRICS, "process_metrics": PROCESS_METRICS, "process_events": PROCESS_EVENTS,
    "net_connections": NET_CONNECTIONS, "system_events": SYSTEM_EVENTS, "self_telemetry": SELF_TELEMETRY, "fault_injections": FAULTS,
    "anomaly_signals": SIGNALS, "incidents": INCIDENTS, "incident_signals": INCIDENT_SIGNALS, "process_fingerprint": FINGERPRINTS,
    "program_info": PROGRAM_INFO, "host_profile": HOST_PROFILE,
}
#: Tables that leave the store in a findings export; the others are raw or private.
FINDINGS = ("fault_injections", "anomaly_signals", "incidents", "incident_signals", "process_fingerprint")

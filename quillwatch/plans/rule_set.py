"""Rules used by the registered queries: every modifier, null, wildcard, keyword, not, 1 of, all of."""

RULES = [
    {"title": "Encoded shell", "id": "r01", "status": "stable", "level": "high", "tags": ["attack.execution", "attack.t1059.001"],
     "detection": {"sel": {"CommandLine|contains": ["-enc", "-EncodedCommand"], "ProcessName": "PowerShell.EXE"}, "condition": "sel"}},
    {"title": "Failed login to ssh", "id": "r02", "status": "stable", "level": "medium", "tags": ["attack.credential_access", "attack.T1110"],
     "falsepositives": ["scanners"],
     "detection": {"fail": {"event_type": "auth_failure"}, "port": {"DestinationPort": [22]}, "condition": "fail and port"}},
    {"title": "No command line", "id": "r03", "status": "stable", "level": "low", "tags": ["attack.defense_evasion"],
     "detection": {"sel": {"event_type": "process_create"}, "cmd": {"CommandLine|contains": "proc"}, "condition": "sel and not cmd"}},
    {"title": "Outbound to watched range", "id": "r04", "status": "stable", "level": "medium", "tags": ["attack.command_and_control", "attack.t1071"],
     "detection": {"net": {"DestinationIp|cidr": ["203.0.113.0/28"]}, "kind": {"event_type|startswith": "network"}, "condition": "net and kind"}},
    {"title": "High counter", "id": "r05", "status": "stable", "level": "critical", "tags": ["attack.exfiltration", "attack.t1041"],
     "detection": {"sel": {"k|contains": "9"}, "num": {"src_port|gte": 9000}, "old": {"src_port|lt": 9400}, "condition": "sel and num and old"}},
    {"title": "Host wildcard", "id": "r06", "status": "stable", "level": "low", "tags": ["attack.lateral_movement"],
     "detection": {"sel_a": {"Hostname": "HOST-1?"}, "sel_b": {"User": "user1*5"}, "condition": "all of sel*"}},
    {"title": "Any of several", "id": "r07", "status": "stable", "level": "medium", "tags": ["attack.discovery", "attack.t1083"],
     "detection": {"s1": {"event_type": "file_access", "dst_port": 443}, "s2": {"User|endswith": "77"}, "s3": ["^|ZZZ-not-there"], "condition": "1 of s* and not none_such"}},
    {"title": "Keyword in raw", "id": "r08", "status": "stable", "level": "info", "tags": ["custom.tag"],
     "detection": {"keywords": ["SHIELD PRO", "relay"], "condition": "keywords"}},
    {"title": "Missing process", "id": "r09", "status": "stable", "level": "medium", "tags": ["attack.persistence"],
     "detection": {"gone": {"ProcessName": None}, "f": {"event_type": "auth_success"}, "condition": "gone and f"}},
    {"title": "List of maps", "id": "r10", "status": "stable", "level": "high", "tags": ["attack.impact"],
     "detection": {"sel": [{"CommandLine|contains|all": ["proc3", "--id"], "dst_port": 22}, {"CommandLine|re": "^proc4 --id [0-9]*7$"}], "condition": "sel"}},
    {"title": "Grouped conditions", "id": "r11", "status": "stable", "level": "low", "tags": ["attack.collection"],
     "detection": {"a": {"event_type": "file_access"}, "b": {"protocol": "tcp"}, "cc": {"dst_port|gt": 8000}, "condition": "(a or cc) and not (a and b) and b"}},
    {"title": "All exact", "id": "r12", "status": "stable", "level": "info", "tags": [],
     "detection": {"sel": {"User|all": ["user12*", "*5"]}, "condition": "any of them"}},
    {"title": "Experimental noise", "id": "r13", "status": "experimental", "level": "critical", "tags": ["attack.impact"],
     "detection": {"sel": {"protocol": "tcp"}, "condition": "sel"}},
]
BY_ID = {r["id"]: r for r in RULES}

# The same rules as SQL predicates over the derived events.
SQL_PREDICATES = {
    "r01": "coalesce(process_cmdline ILIKE '%-enc%' OR process_cmdline ILIKE '%-EncodedCommand%', false) AND coalesce(lower(process_name) = 'powershell.exe', false)",
    "r02": "event_type = 'auth_failure' AND dst_port = 22",
    "r03": "event_type = 'process_create' AND NOT coalesce(process_cmdline ILIKE '%proc%', false)",
    "r04": "dst_ip LIKE '203.0.113.%' AND CAST(split_part(dst_ip, '.', 4) AS INT) < 16 AND event_type LIKE 'network%'",
    "r05": "CAST(k AS VARCHAR) LIKE '%9%' AND src_port >= 9000 AND src_port < 9400",
    "r06": "coalesce(regexp_full_match(lower(hostname), 'host-1.'), false) AND regexp_full_match(user_name, 'user1.*5')",
    "r07": "(event_type = 'file_access' AND dst_port = 443) OR user_name LIKE '%77' OR raw ILIKE '%^|ZZZ-not-there%'",
    "r08": "raw ILIKE '%shield pro%' OR raw ILIKE '%relay%'",
    "r09": "process_name IS NULL AND event_type = 'auth_success'",
    "r10": "coalesce(process_cmdline LIKE '%proc3%' AND process_cmdline LIKE '%--id%' AND dst_port = 22, false) OR coalesce(regexp_matches(process_cmdline, '^proc4 --id [0-9]*7$'), false)",
    "r11": "(event_type = 'file_access' OR dst_port > 8000) AND NOT (event_type = 'file_access' AND protocol = 'tcp') AND protocol = 'tcp'",
    "r12": "regexp_full_match(user_name, 'user12.*') AND regexp_full_match(user_name, '.*5')",
    "r13": "protocol = 'tcp'",
}

"""Sessions that share a state key: few states, and each session by its own events and its own end."""

import datetime as dt
import random

from test_stateful import EVENT

from paperstrata.streaming import stateful

HOURS = 5


def test_neighbours_share_a_state_and_end_each_at_its_own_time(spark, tmp_path):
    rng, own = random.Random(2), stateful.stream_session(spark)
    start, states, want, held = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), {}, [], []
    for n in range(4):
        hours = sorted(n * 3 + 3 * rng.random() + 0.001 for _ in range(160))
        batch = [(rng.randint(-70, 130), rng.choice("ab"), start + dt.timedelta(hours=h), rng.choice(["start", "start", "close"])) for h in hours]
        for id, collection, at, kind in batch:
            state = states.get(id)
            if kind == "start" and state is None:
                states[id] = ["open", at + dt.timedelta(hours=HOURS), collection]
                want.append((id, collection, "open"))
            elif kind == "close" and state and state[0] == "open":
                state[0] = "closed"
                want.append((id, state[2], "closed"))
        mark = int(batch[-1][2].timestamp() * 1000)  # the watermark, in milliseconds
        for id, state in states.items():
            if state[0] == "open" and round(state[1].timestamp() * 1000) <= mark:
                state[0] = "expired"
                want.append((id, state[2], "expired"))
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        query = stateful.follow(stateful.session_states(stream, HOURS), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    said = [(r["id"], r["collection"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(said) == sorted(want) and {s for _, _, s in want} == {"open", "closed", "expired"}
    shards = len({id >> 6 for id in states})
    assert max(held) < len(states) / 2 and shards < len(states) / 20

"""A result as one HTML page that needs nothing else: filter, search, sort, label and export in plain script."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title><style>
body{font:15px/1.5 system-ui,sans-serif;margin:0;color:#222;background:#f7f7f5}header,nav{padding:10px 18px;background:#fff;border-bottom:1px solid #ddd}
nav label{margin-right:14px;white-space:nowrap}nav input[type=number]{width:70px}main{display:flex;height:calc(100vh - 150px)}
#list{width:36%;overflow:auto;border-right:1px solid #ddd}#list div{padding:8px 14px;border-bottom:1px solid #eee;cursor:pointer}#list .on{background:#e8eefc}
#one{flex:1;overflow:auto;padding:14px}.side{display:flex;gap:16px}.side section{flex:1;background:#fff;padding:12px;border:1px solid #ddd}mark{background:#fde68a}
.high{color:#166534}.medium{color:#92400e}.low{color:#991b1b}p[dir=auto]{font-size:18px}</style></head><body>
<header><b>@TITLE@</b> <span id="stats"></span></header><nav id="bar"></nav><main><div id="list"></div><div id="one"></div></main>
<script id="data" type="application/json">@DATA@</script><script>
const data=JSON.parse(document.getElementById('data').textContent),labels={},esc=s=>String(s).replace(/[&<>"]/g,c=>'&#'+c.charCodeAt(0)+';');
const get=(e,k)=>{const a=e.alignment;return k==='core_similarity'?a.core_similarity??a.similarity:k==='content_weight'?a.content_weight??a.avg_match_weight??1:k==='span_coverage'?a.span_coverage??1:k==='length'?a.length:k==='position'?e.source.global_range.start:k==='id'?e.id:a.similarity};
const view={similarity:0,length:0,core_similarity:0,span_coverage:0,content_weight:0,search:'',by:'core_similarity',desc:true};let open=null;
const band=(v,h,m)=>v>=h?'high':v>=m?'medium':'low',mins=['similarity','length','core_similarity','span_coverage','content_weight'];
document.getElementById('bar').innerHTML=mins.map(k=>`<label>${k} &ge; <input type=number step=any value=0 data-k=${k}></label>`).join('')+'<label>text <input data-k=search></label><label>sort <select data-k=by>'+['core_similarity','span_coverage','content_weight','similarity','length','position','id'].map(k=>`<option>${k}</option>`).join('')+'</select></label><button id=turn>order</button> <button id=save>export labelled</button>';
function shown(){const f=data.edges.filter(e=>mins.every(k=>!(get(e,k)<view[k]))&&(!view.search||e.source.text.matched.includes(view.search)||e.target.text.matched.includes(view.search)));return f.sort((a,b)=>{const c=get(a,view.by)-get(b,view.by)||a.id-b.id;return view.desc?-c:c})}
function draw(){const s=shown(),n=x=>Object.values(labels).filter(v=>v===x).length;document.getElementById('stats').textContent=`${s.length} of ${data.edges.length} edges, ${n('valid')} valid, ${n('noise')} noise`;
document.getElementById('list').innerHTML=s.map(e=>{const t=e.source.text.matched;return `<div data-id=${e.id} class="${open===e.id?'on':''}">#${e.id} <span class=${band(get(e,'core_similarity'),.9,.7)}>${(get(e,'core_similarity')*100).toFixed(1)}%</span> len ${e.alignment.length} ${labels[e.id]||''}<br><span dir=auto>${esc(t.length>60?t.slice(0,60)+'...':t)}</span></div>`}).join('');
const e=data.edges.find(e=>e.id===open),one=document.getElementById('one');if(!e){one.textContent='';return}const a=e.alignment;
const side=x=>`<section><b>Book ${x.book_id}</b> ${esc(x.location)}<p dir=auto>${esc(x.text.before)} <mark>${esc(x.text.matched)}</mark> ${esc(x.text.after)}</p></section>`;
one.innerHTML=`<p>${Object.entries(a).map(([k,v])=>`${k}: ${Number.isInteger(v)?v:(+v).toFixed(3)}`).join(' &middot; ')}</p><p><button data-l=valid>valid</button> <button data-l=noise>noise</button></p><div class=side>${side(e.source)}${side(e.target)}</div>`}
document.getElementById('bar').oninput=x=>{const k=x.target.dataset.k;if(k){view[k]=mins.includes(k)?+x.target.value:x.target.value;draw()}};document.getElementById('turn').onclick=()=>{view.desc=!view.desc;draw()};
document.getElementById('list').onclick=x=>{const d=x.target.closest('[data-id]');if(d){open=+d.dataset.id;draw()}};document.getElementById('one').onclick=x=>{const l=x.target.dataset.l;if(l){labels[open]=labels[open]===l?undefined:l;draw()}};
document.getElementById('save').onclick=()=>{const q=s=>'"'+String(s).replace(/"/g,'""')+'"',rows=[['id','validation','source_location','source_text','target_location','target_text','length','lemma_matches','substitutions','gaps','core_similarity','span_coverage','content_weight','similarity'].join(',')];
shown().filter(e=>labels[e.id]).forEach(e=>{const a=e.alignment;rows.push([e.id,labels[e.id],q(e.source.location),q(e.source.text.matched),q(e.target.location),q(e.target.text.matched),a.length,a.lemma_matches,a.substitutions??0,a.gaps,get(e,'core_similarity').toFixed(4),get(e,'span_coverage').toFixed(4),get(e,'content_weight').toFixed(4),a.similarity.toFixed(4)].join(','))});
const u=URL.createObjectURL(new Blob([rows.join('\\n')],{type:'text/csv'})),a=document.createElement('a');a.href=u;a.download='labelled-edges.csv';a.click();URL.revokeObjectURL(u)};draw();
</script></body></html>
"""


def viewer_html(header: dict, edges: list[str]) -> str:
    """The page for a result's header and its nested edges as JSON strings. A book without a title is called 'Book N'."""
    name = lambda b: b.get("title") or f"Book {b['id']}"
    title = html.escape(f"{name(header['book_a'])} ↔ {name(header['book_b'])}")
    data = json.dumps(header, ensure_ascii=False)[:-1] + ', "edges": [' + ",".join(edges) + "]}"
    return _PAGE.replace("@TITLE@", title).replace("@DATA@", data.replace("</", "<\\/").replace("<!--", "<\\!--"))


def write_viewer_file(header: dict, nested: DataFrame, path: str | Path) -> None:
    """A page of one pair's edges, which a browser must be able to hold; the comparison of many pairs goes to tables."""
    edges = [r.j for r in nested.orderBy("id").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    Path(path).write_text(viewer_html(header, edges), encoding="utf-8")
